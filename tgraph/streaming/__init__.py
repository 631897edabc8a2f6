"""Structured Streaming operators over edge streams.

Edges arrive as files with columns ``edge_pos, src, tgt, t`` (and others) and
``ts``, the event time.  The size of a micro-batch is bounded by the source's
own limit (``maxFilesPerTrigger`` and the like).
"""
