"""Tokens and stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tgraph.functions.arrays import let

# Words of two or more letters, digits or underscores, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"

# English stop words.
STOP_WORDS = tuple(
    """
    a about above across after afterwards again against all almost alone along already also although
    always am among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere
    are around as at back be became because become becomes becoming been before beforehand behind being
    below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt
    cry de describe detail do done down due during each eg eight either eleven else elsewhere empty enough
    etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five
    for former formerly forty found four from front full further get give go had has hasnt have he hence
    her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in
    inc indeed interest into is it its itself keep last latter latterly least less ltd made many may me
    meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never
    nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only
    onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re
    same see seem seemed seeming seems serious several she should show side since sincere six sixty so some
    somehow someone something sometime sometimes somewhere still such system take ten than that the their
    them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin
    third this those though three through throughout thru thus to together too top toward towards twelve
    twenty two un under until up upon us very via was we well were what whatever when whence whenever where
    whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom
    whose why will with within without would yet you your yours yourself yourselves
    """.split()
)


def word_counts(words: Column) -> Column:
    """Sorted array of (word, tf) of an array's different words, counted inside the row."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        places = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("word"), (F.coalesce(F.get(at, k + 1), n) - i).cast("double").alias("tf"))))

    return let(F.array_sort(words), runs)


def tokens(text: Column | str, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words without stop words, in text order."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words
