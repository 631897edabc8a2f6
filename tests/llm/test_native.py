"""Line dedup, mixing, decontamination, chat and URLs against brute force, and their edges."""

import collections
import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tgraph.llm import chat, decontam, linededup, mixing, urlfilter

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# line dedup


def brute_lines(rows, ratio=0.1, least=5, most=0.5):
    pages = collections.defaultdict(set)
    for _, host, text in rows:
        if text is not None:
            pages[host].add(text)
    n = collections.Counter((h, line) for h, texts in pages.items() for t in texts for line in {x.strip(" \t\r") for x in t.split("\n")})
    common = {(h, line) for (h, line), c in n.items() if line and c >= least and c > ratio * len(pages[h])}
    out = []
    for i, host, text in rows:
        lines = (text or "").split("\n")
        rest = [x for x in lines if (host, x.strip(" \t\r")) not in common]
        cuts = sum(map(len, rest)) >= (1 - most) * sum(map(len, lines)) and len(rest) < len(lines)
        out.append((i, text if text is None or not cuts else "\n".join(rest), len(lines) - len(rest) if cuts and text is not None else 0))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    rows = [(1, "a", None), (2, None, "x\ny"), (3, "a", ""), (4, "b", "menu")]
    for i in range(80):
        host = rng.choice(["a", "a", "b", None])
        body = [f"line {rng.randrange(10**6)} of the body" for _ in range(rng.randrange(0, 6))]
        rows.append((10 + i, host, "\n".join(rng.choice([["menu"], ["  menu\t"], [], ["", "menu", "menu"]]) + body + rng.choice([["foot"], []]))))
    rows += [(200 + i, "a", "copied text\nof many lines") for i in range(60)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, source string, text string, _lines int")
    got = linededup.drop_boilerplate(docs).select("doc_id", "text", "_lines.dropped").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(rows), key=str)
    assert any(d for _, _, d in got) and linededup.drop_boilerplate(docs.where("false")).count() == 0


def test_line_on_a_small_share_of_a_host_is_dropped(spark):
    page = lambda i: [f"body {i} of a page", f"more of body {i}", f"end of body {i}"]
    rows = [(i, "a", "\n".join((["menu"] if i < 24 else ["rare"] if i < 28 else []) + page(i))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = linededup.drop_boilerplate(docs).select("doc_id", "text", "_lines.dropped").collect()
    assert sorted(map(tuple, got)) == brute_lines(rows, ratio=0.01)
    assert {r.doc_id for r in got if r.dropped} == set(range(24))


# mixing


def test_mix_meets_the_marginals(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice("ab" * 4 + "c"), rng.choice(["en", "en", "de", None]), i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, _mix int")
    targets = {"source": {"a": 0.25, "b": 0.25, "c": 0.5}}
    cells = docs.groupBy("source", "lang").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("tokens"))
    raked = mixing.rake(cells, {"lang": 0.5, "source": 1.0}, targets).toPandas()
    assert raked.groupby("source").weight.sum().round(6).to_dict() == {"a": 0.25, "b": 0.25, "c": 0.5}
    t = cells.groupBy("lang").agg(F.sum("tokens").alias("t")).toPandas().set_index("lang").t ** 0.5
    assert math.isclose(raked[raked.lang == "de"].weight.sum(), t["de"] / t.sum(), rel_tol=1e-6)
    mixed = mixing.mix(docs, 0.3, {"source": 1.0}, targets).select("source", "_mix.*").toPandas()
    assert math.isclose((mixed.probability * mixed.tokens).sum(), 0.3 * mixed.tokens.sum(), rel_tol=1e-9)
    kept = mixed[mixed.kept].groupby("source").tokens.sum() / mixed[mixed.kept].tokens.sum()
    assert abs(kept["c"] - min(0.5, mixed[mixed.source == "c"].tokens.sum() / (0.3 * mixed.tokens.sum()))) < 0.06


def test_mix_edges(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "x y", None), (2, "z " * 9, "b"), (3, "", "only empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    got = mixing.mix(docs).select("doc_id", "_mix.*").collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    assert len({r.kept for r in got if r.doc_id == 1}) == 1
    assert mixing.mix(docs.where("false")).count() == 0
    assert [r.topic for r in mixing.mix(spark.createDataFrame([(1, "see Copyright", "s", "l")], "doc_id bigint, text string, source string, lang string")).select("_mix.topic").collect()] == ["legal"]


# decontamination


def brute_hits(docs, items, window=10):
    cut = lambda t: TOKEN.findall((t or "").translate(LOWER))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n and i is not None else 0):
            wins[tuple(w[s : s + n])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = cut(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if found := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    words = ["the", "of", "Zug", "éa", "x1", "Ä"] + [f"r{i}" for i in range(30)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 10, 11, 25, 60]))) for i in range(25)] + [(30, None), (31, "..."), (None, text(12)), (32, "the of"), (32, text(15)), (33, "the of")]
    docs = [(1, None), (2, ""), (3, "!!"), (None, items[3][1])]
    for i in range(60):
        parts = [text(rng.randrange(0, 50))]
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(items)[1] or ""
            a = rng.randrange(0, max(1, len(t) // 2))
            parts += [rng.choice([t, t[a:], t[:-5].upper()]), text(rng.randrange(0, 5))]
        docs.append((10 + i, " ".join(parts)))
    docs += [docs[8]] * 3 + [(500, (items[5][1] + " ") * 400)]
    table = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id bigint, text string, words int, doc_key string")
    bench = spark.createDataFrame([(*i, "c") for i in items], "item_id bigint, text string, at string")
    got = decontam.contamination(table, bench).select("doc_id", "_contamination.*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_hits(docs, items), key=str)
    none = decontam.contamination(table, bench.where("false")).select("_contamination.*").collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert decontam.contamination(table.where("false"), bench).count() == 0


# chat


def records(spark, rows):
    return spark.createDataFrame([(c, t, json.dumps(r)) for c, t, r in rows], "conv_id bigint, turn bigint, json string").withColumn("record", F.parse_json("json"))


def test_layouts_become_turns(spark):
    rows = [
        (1, 0, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 9}),
        (2, 0, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}),
        (3, 0, {"instruction": "q", "output": "a", "meta": {"x": 1}}),
        (4, 0, {"instruction": "q", "input": "i", "output": "a", "system": "s"}),
        (5, 0, {"prompt": "q", "completion": "a"}),
        (6, 0, {"prompt": "q", "response": "a"}),
        (7, 0, {"question": "q", "answer": "a"}),
        (8, 1, {"role": "assistant", "text": "a"}),
        (8, 0, {"role": "user", "text": "q"}),
        (9, 0, {"role": None, "content": None}),
    ]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_conversations(records(spark, rows))).collect()}
    plain = [("user", "q"), ("assistant", "a")]
    assert all(got[i] == plain for i in (1, 2, 3, 5, 6, 7, 8))
    assert got[4] == [("system", "s"), ("user", "q"), ("user", "i"), ("assistant", "a")] and got[9] == [("", "")]


def test_control_strings_come_back(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<|", "<\\|", "|>", "\n", "assistant", "é", "😀", " ", "", "user\n", "$1"]
    rows = [(i // 70, i, {"role": rng.choice(["user", "assistant", "tool\nx", "<|im_end|>\\"]), "text": "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))}) for i in range(700)]
    rows += [(99, None, {"role": "user", "text": "null turn"}), (99, 0, {"role": "assistant", "text": None}), (None, 0, {"role": "user", "text": "x"})]
    out = chat.read_back(chat.format_conversations(records(spark, rows))).collect()
    want = collections.defaultdict(list)
    for c, _, r in sorted(rows, key=lambda x: (x[0] is None, x[0], x[1] is not None, x[1] or 0)):
        want[c].append((r["role"] or "", r["text"] or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == dict(want)
    assert all(r.loss_text == "".join(t for role, t in want[r.conv_id] if role == "assistant") for r in out)


def test_unknown_layouts_are_named(spark):
    assert chat.format_conversations(records(spark, [(1, 0, {"role": "user", "text": ""})]).where("false")).count() == 0
    with pytest.raises(Exception, match="no mapping for records of fingerprint"):
        chat.format_conversations(records(spark, [(1, 0, {"speaker": "x"})])).collect()


def test_incomplete_records_and_rejects(spark):
    rows = [
        (1, 0, {"messages": []}),
        (2, 0, {"messages": []}), (2, 1, {"messages": [{"role": "user", "content": "q"}, {"content": "c"}, {"role": "assistant"}, {}]}),
        (3, 0, {"role": "user"}), (3, 1, {"text": "t"}), (3, 2, {"role": "assistant", "text": "a", "content": "b"}),
        (4, 0, {"conversations": [{"from": "gpt"}]}),
    ]
    unknown = [
        (3, 3, {"speaker": "x", "said": [{"at": 1.5, "t": None}, {"u": [[True]]}]}), (5, 0, {"said": [{"u": [["q"]], "at": "s", "t": 1}], "speaker": 7}),
        (5, 1, {"messages": "no list"}), (5, 1, {"messages": "no list"}), (5, 2, "text"),
    ]
    table = records(spark, rows + unknown)
    out = chat.read_back(chat.format_conversations(table, unknown="reject")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == {
        1: [], 2: [("user", "q"), ("", "c"), ("assistant", ""), ("", "")], 3: [("user", ""), ("", "t"), ("assistant", "a")], 4: [("assistant", "")]
    }
    assert {r.conv_id: r.formatted for r in out}[1] == "" and {r.conv_id: r.loss_text for r in out}[3] == "a"
    lost = chat.rejected(table).collect()
    assert sorted((r.conv_id, r.turn) for r in lost) == [(3, 3), (5, 0), (5, 1), (5, 1), (5, 2)]
    found = {(r.conv_id, r.turn): (r.paths, r.fingerprint) for r in lost}
    assert found[3, 3] == found[5, 0] and found[3, 3][0] == "OBJECT<said: ARRAY<OBJECT<at: _, t: _, u: ARRAY<ARRAY<_>>>>, speaker: _>"
    assert len({f for _, f in found.values()}) == 3
    with pytest.raises(ValueError, match="unknown"):
        chat.format_conversations(table, unknown="skip")


# URLs

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def brute_ratio(counts, gram):
    """log P(accepted) - log P(rejected) by the recursive definition."""

    def p(kind, k):
        if k < 0:
            return 1 / urlfilter.ALPHABET
        tail = gram[len(gram) - 1 - k :]
        after = collections.Counter()
        for g, n in counts[kind].items():
            if g[len(g) - 1 - k : -1] == tail[:-1]:
                after[g[-1]] += n
        total, kinds = sum(after.values()), len(after)
        return (after[tail[-1]] + kinds * p(kind, k - 1)) / (total + kinds) if total else p(kind, k - 1)

    return math.log(p("a", urlfilter.ORDER)) - math.log(p("r", urlfilter.ORDER))


def test_parts_and_rules_of_urls(spark):
    cases = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"), "https://net/": ("net", "/", "net/"), "http://net": ("net", "", None),
        "ftp://xnet/a": ("xnet", "/a", None), "http://a.org/fr/": ("a.org", "/fr/", "org/fr/"), "http://a.org/fr": ("a.org", "/fr", None),
        "http://u@EXAMPLE.com:80/de/?x": ("u@example.com:80", "/de/", None), "a?b://c/d": ("c", "/d", None), "nothing": ("", "", None), "": ("", "", None),
        "http://É.net/ü": ("É.net", "/ü", "net/"), "http://x.example.com/de/a://b": ("x.example.com", "/de/a://b", "example.com/de/"), "http://h#://x/": ("h", "", None), None: ("", "", None),
    }
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(cases)], "page_id bigint, url string, told string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.judge(pages, RULES).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_models_by_definition(spark):
    pad = lambda t: "\x02" * urlfilter.ORDER + t + "\x03"
    texts = {"a": ["abcab", "abd", "é"], "r": ["xyz", "abx", "ab"]}
    counts = {k: collections.Counter(pad(t)[i : i + urlfilter.ORDER + 1] for t in v for i in range(len(t) + 1)) for k, v in texts.items()}
    every = set(counts["a"]) | set(counts["r"]) | {"zzzzz", "\x02abcz", "aabca"}
    table = spark.createDataFrame([(g, counts["a"][g], counts["r"][g]) for g in set(counts["a"]) | set(counts["r"])], "gram string, a bigint, r bigint")
    wanted = spark.createDataFrame([(g,) for g in every], "gram string")
    for g, ratio in urlfilter.log_ratios(table, wanted).collect():
        assert math.isclose(ratio, brute_ratio(counts, g), abs_tol=1e-9)


def test_models_part_good_from_bad(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        good = i % 2 == 0
        word = "".join(rng.choice("abcde" if good else "vwxyz") for _ in range(10))
        told = rng.random() < 0.6
        rows.append((i, f"http://{'h.org' if good else 'h.net'}/fr/{word}" if told else f"http://h.info/fr/{word}"))
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), RULES).collect()}
    asked = [i for i, u in rows if "info" in u]
    assert sum((got[i].verdict == "allow") == (i % 2 == 0) for i in asked) > 0.95 * len(asked)


def test_models_read_query_strings_and_fragments(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        good, told = i % 2 == 0, rng.random() < 0.6
        word = "".join(rng.choice("abcde" if good else "vwxyz") for _ in range(12))
        host = ("a.org" if good else "a.net") if told else "a.info"
        rows.append((i, rng.choice([f"http://{host}/fr/?q={word}", f"http://{host}/fr/#{word}"]) if told or i % 4 < 2 else word))
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), RULES).collect()}
    asked = [i for i, _ in rows if got[i].rule is None]
    assert any("://" not in rows[i][1] for i in asked) and sum((got[i].verdict == "allow") == (i % 2 == 0) for i in asked) > 0.95 * len(asked)
    cases = {"HTTP://A.B/c?D#e": "a.b/c?D#e", "x?y": "x?y", "": "", None: "", "a://É.Net?q\n#f": "É.net?q\n#f", "u://": ""}
    table = spark.createDataFrame([(u,) for u in cases], "url string").select(urlfilter.text_of(F.col("url")).alias("t"))
    assert [r.t for r in table.collect()] == list(cases.values())


def test_urls_without_examples(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, None)], "page_id bigint, url string")
    assert [r.verdict for r in urlfilter.judge(pages, RULES).collect()] == ["allow", "allow"]
    assert urlfilter.judge(pages.where("false"), RULES).count() == 0
