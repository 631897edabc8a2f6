"""Registered queries and the SQL that must give the same rows."""

from catalog import cleaning, detection, features, graphs, injection, reports, scoring, sources, streams

MODULES = (cleaning, detection, reports, injection, features, graphs, scoring, sources, streams)
