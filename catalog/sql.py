"""Shared SQL for the base tables."""

BIP = """
bip0 AS (
  SELECT o_custkey AS src,
         (SELECT max(o_custkey) + 1 FROM orders) + l_suppkey AS tgt,
         epoch_us(o_orderdate) AS t,
         sum(l_quantity) AS qty, avg(l_discount) AS disc,
         sum(l_extendedprice) AS price,
         CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS label
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY 1, 2, 3),
bip AS (SELECT *, row_number() OVER (ORDER BY t, src, tgt) - 1 AS edge_pos FROM bip0)
"""

UG = """
ug0 AS (
  SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS tgt, epoch_us(ts) AS t
  FROM (SELECT user_id AS a, ts,
               lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b
        FROM events)
  WHERE b IS NOT NULL AND a <> b),
ug AS (SELECT *, row_number() OVER (ORDER BY t, src, tgt) - 1 AS edge_pos FROM ug0)
"""


def split(name: str, out: str, train: float = 0.5, val: float = 0.25) -> str:
    return f"""
{out} AS (
  SELECT e.*, CASE WHEN t <= q.a THEN 'train' WHEN t <= q.b THEN 'val' ELSE 'test' END AS split
  FROM {name} e,
       (SELECT quantile_cont(t, {train}) AS a, quantile_cont(t, {train + val}) AS b
        FROM {name}) q)
"""


BIP_S = BIP + "," + split("bip", "bs")
UG_S = UG + "," + split("ug", "us")

SCORED = """
scored AS (
  SELECT d.doc_id AS id, CAST(n_chars AS DOUBLE) AS score,
         CAST(toxic AS BIGINT) AS label, source AS grp, lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def u01(seed: object, *keys: str) -> str:
    """The hash-based uniform of ``tgraph.functions.random.u01``."""
    parts = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return (
        f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13)) AS BIGINT)"
        " / 4503599627370496.0::DOUBLE)"
    )


def pick(size: str, seed: object, *keys: str) -> str:
    return f"CAST(floor({u01(seed, *keys)} * {size}) AS BIGINT)"


def permuted(name: str, size: str, seed: object, most: str) -> str:
    """Table ``name`` (cand, code): the permutation of ``tgraph.functions.random.permuted``.

    ``size`` is a scalar; numbers ``cand`` go up to ``most`` or the whole range.
    """
    steps = [
        f"{name}_h AS (SELECT m, greatest(1, (length(bin(m - 1)) + 1) // 2) AS h FROM (SELECT CAST({size} AS BIGINT) AS m))",
        f"{name}_0 AS (SELECT id AS cand, m, h, id >> h AS l, id & ((1::BIGINT << h) - 1) AS r FROM {name}_h,"
        f" range(0, (SELECT CAST(least(1::BIGINT << (2 * h), {most}) AS BIGINT) FROM {name}_h)) q(id))",
    ]
    for i in range(4):
        mixed = pick("(1::BIGINT << h)", seed, f"'round{i}'", "r")
        steps.append(f"{name}_{i + 1} AS (SELECT cand, m, h, r AS l, xor(l, {mixed}) AS r FROM {name}_{i})")
    steps.append(f"{name} AS (SELECT cand, (l << h) | r AS code FROM {name}_4 WHERE ((l << h) | r) < m)")
    return ",\n".join(steps)
