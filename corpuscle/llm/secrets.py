"""Secret scans (op 2): pattern spans, and sliding-window Shannon entropy per character class.

DataFrame functions only. Spans come from one regex pass that extracts the matches and, only for
texts with a match, a split at the same regex: lengths of the gaps and matches give code-point
offsets. Candidate strings of a character class are folded character by character: counts of the
window's characters are updated for the one that enters and the one that leaves, and with them
the sum of c*log2(c), so each step is O(alphabet) and no window is counted anew; a candidate's characters
are read as an array once. A candidate whose best window reaches the class's threshold is a span unless the allow
list suppresses it. Folds that gather a list do so in blocks of FOLD, so they stay near linear in very long texts.

Defined results: null text is empty text; empty text has no span and base_sha256 of the empty
string; every input row gives one row (repeated rows repeat); other input columns are ignored by
``scan`` and kept by ``redact``; an empty table gives an empty result. There is no shuffle: a
hot source or group of copies is spread as the scan spreads it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYWORD = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Window of the entropy scan, in characters; a candidate has at least that many.
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_]{%d,}" % WINDOW
#: Least entropy of the best window, in bits a character, by class.
HEX_BITS, BASE64_BITS = 3.05, 3.75
#: Fixed values. Candidates that hold one of these are documentation, alphabets or digests of nothing.
ALLOWED = (
    "EXAMPLE",
    "example",
    "0123456789",
    "1234567890",
    "abcdefghijklm",
    "ABCDEFGHIJKLM",
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)
KINDS = ("assign", "access", "hex", "entropy")
MASK = "<SECRET>"


#: Elements that a fold gathers at a time.
FOLD = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blockwise(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], finish: Callable[[Column, Column], Column]) -> Column:
    """Fold of ``items`` from at = 0: step(at, x) gives the next ``at`` and an array of results (of type ``kind``); finish(results, at)."""
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def inner(a: Column, x: Column) -> Column:
        at, out = step(a["at"], x)
        return F.struct(at.alias("at"), F.concat(a["out"], out).alias("out"))

    def outer(all_: Column, a: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(all_, k * FOLD + 1, FOLD), F.struct(a["at"].alias("at"), none.alias("out")), inner)
        return _let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(a["out"], F.array(p["out"])).alias("out")))

    def whole(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int"))
        folded = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nested.alias("out")), lambda a, k: outer(all_, a, k))
        return _let(folded, lambda f: finish(F.flatten(f["out"]), f["at"]))

    return _let(items, whole)


def _spans(text: Column, found: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start, kind, end>> of the matches for which keep(match) holds."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), F.transform(found, lambda m: F.length(m)).alias("n"))
    starts = _blockwise(pairs, "int", lambda at, x: (at + x["g"] + x["n"], F.array(at + x["g"])), lambda out, _: out)
    rows = F.transform(F.arrays_zip(starts.alias("s"), found.alias("m")), lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))
    kept = F.transform(F.filter(rows, lambda r: keep(r["m"])), lambda r: F.struct(r["start"], r["kind"], r["end"]))
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


#: The characters of candidates, by which the windows are counted.
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_"


def best_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the windows of a candidate string; 0 if it is shorter. Linear in its length."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    number = F.array(*[F.lit(_ALPHABET.find(chr(c))) for c in range(128)])
    state = F.struct(F.array_repeat(F.lit(0), len(_ALPHABET)).alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        into, out = x["into"], x["out"]
        n_in = F.get(a["c"], into)
        n_out = F.get(a["c"], out) + F.when(out == into, 1).otherwise(0)
        total = a["s"] + F.get(weight, n_in + 1) - F.get(weight, n_in) + F.when(out >= 0, F.get(weight, n_out - 1) - F.get(weight, n_out)).otherwise(0.0)
        counts = F.transform(a["c"], lambda c, k: c + (k == into).cast("int") - (k == out).cast("int"))
        bits = F.when(a["n"] + 1 >= window, F.lit(math.log2(window)) - total / window).otherwise(0.0)
        return F.struct(counts.alias("c"), total.alias("s"), F.greatest(a["best"], bits).alias("best"), (a["n"] + 1).alias("n"))

    def folded(codes: Column) -> Column:
        leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), F.lit(1), F.size(codes))
        return F.aggregate(F.arrays_zip(codes.alias("into"), leaving.alias("out")), state, step, lambda a: a["best"])

    return _let(F.transform(F.split(s, "", -1), lambda c: F.get(number, F.ascii(c))), lambda codes: folded(F.filter(codes, lambda c: c >= 0)))


def _is_secret(m: Column) -> Column:
    allowed = F.lit(False)
    for a in ALLOWED:
        allowed = allowed | m.contains(a)
    hexa = m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return mixed & ~allowed & (best_entropy(m) >= F.when(hexa, HEX_BITS).otherwise(BASE64_BITS))


def with_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a further column, and its name: array of (start, kind, end), sorted; end exclusive, in code points."""
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    t = F.coalesce(F.col(text), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "cand": CANDIDATE}
    found = docs.select("*", *[F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias(free + name) for name, p in patterns.items()])
    always = lambda m: F.lit(True)
    matches = {name: F.col(free + name) for name in patterns}
    spans = F.concat(
        _spans(t, matches["assign"], ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        _spans(t, matches["access"], ACCESS, 1, always),
        _spans(t, matches["hex"], HEX, 2, always),
        F.when(F.exists(matches["cand"], lambda m: m.rlike("[0-9]")), _spans(t, matches["cand"], CANDIDATE, 3, _is_secret)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")),
    )
    return found.withColumn(free + "spans", F.array_sort(spans)).drop(*[free + name for name in patterns]), free + "spans"


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of each row; see the module's text for the defined results."""
    rows, spans = with_spans(docs.select(key, text), text)
    of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return rows.select(
        key,
        *[of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_digest(base).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col(spans)).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each run of overlapping spans in ``text`` replaced by MASK; null text stays null.

    What stays between the spans is cut in blocks of FOLD pieces, so a long text isn't walked from its start for each.
    """
    rows, spans = with_spans(docs, text)
    t = F.col(text)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.array(F.struct(at.alias("lo"), s["start"].alias("hi")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, piece).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))

    def cut(pieces: Column, first: Column) -> Column:
        inside = lambda part: F.transform(pieces, lambda p: F.substring(part, p["lo"] - first + 1, p["hi"] - p["lo"]))
        return _let(F.substring(t, first + 1, F.element_at(pieces, -1)["hi"] - first), lambda part: F.array_join(inside(part), MASK))

    def joined(pieces: Column, at: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / FOLD).cast("int"))
        parts = F.transform(blocks, lambda k: _let(F.slice(pieces, k * FOLD + 1, FOLD), lambda ps: cut(ps, F.get(ps, F.lit(0))["lo"])))
        return F.concat(F.array_join(parts, MASK), F.lit(MASK), F.substring(t, at + 1, F.length(t)))

    clean = _blockwise(F.col(spans), "struct<lo:int,hi:int>", step, joined)
    return rows.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(t)).drop(spans)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_spans(name: str, pattern: str, kind: int) -> str:
    p = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT r, doc_id, {kind} AS kind, m, (st + 0)::BIGINT AS s, st + length(m) AS e FROM (
    SELECT r, doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS st
    FROM (SELECT r, doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM d)))"""


_ALLOW_SQL = " AND ".join(f"NOT contains(m, '{a}')" for a in ALLOWED)
_A2 = ASSIGN.replace("'", "''")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_sql_spans("a", ASSIGN, 0)},
{_sql_spans("k", ACCESS, 1)},
{_sql_spans("x", HEX, 2)},
{_sql_spans("c", CANDIDATE, 3)},
w AS (SELECT DISTINCT m, i, substr(m, i, {WINDOW}) AS win FROM (SELECT m, unnest(range(1, length(m) - {WINDOW} + 2)) AS i FROM
      (SELECT DISTINCT m FROM c WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND {_ALLOW_SQL}))),
n AS (SELECT m, i, ch, count(*) AS n FROM (SELECT m, i, unnest(string_split(win, '')) AS ch FROM w) GROUP BY ALL),
h AS (SELECT m, max(bits) AS bits FROM (SELECT m, i, -sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)) AS bits FROM n GROUP BY m, i) GROUP BY m),
s AS (SELECT r, kind, s, e FROM a WHERE length(regexp_extract(m, '{_A2}', 2)) >= 6
  UNION ALL SELECT r, kind, s, e FROM k UNION ALL SELECT r, kind, s, e FROM x
  UNION ALL SELECT c.r, c.kind, c.s, c.e FROM c JOIN h ON c.m = h.m
            WHERE bits >= CASE WHEN regexp_matches(c.m, '^([0-9a-f]+|[0-9A-F]+)$') THEN {HEX_BITS} ELSE {BASE64_BITS} END),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
  string_agg(['assign','access','hex','entropy'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
  string_agg(['assign','access','hex','entropy'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM s GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(n_entropy, 0)::BIGINT AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.r = g.r
"""
