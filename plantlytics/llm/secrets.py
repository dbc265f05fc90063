"""Secrets in texts: known shapes, and sliding-window entropy of candidate strings. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import pick, read

#: The known shapes.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
#: Runs are maximal, so leaving out short ones here finds the same spans as filtering them afterwards.
HEX = "[0-9a-f]{16,}"

#: Strings worth measuring, window length in characters, and least entropy in bits per character class.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = {"entropy_hex": 3.0, "entropy_base64": 3.8}
#: Candidates that are no secrets: numbers, UUIDs, words with few digits, anything without both letters and digits.
ALLOWED = (
    r"^[0-9+/_=-]*$", r"^[A-Za-z+/_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([/_-][A-Za-z]+)*[/_-]?[0-9]{1,4}$",
)
#: Thousandths of c * log2(c): whole numbers, so the running sum is exact.
_TERMS = [round(1000 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]
#: First and last places in the alphabet, from 1, of hex letters and of digits.
_UPPER, _LOWER, _DIGITS = ((ALPHABET.index(a) + 1, ALPHABET.index(b) + 1) for a, b in ("AF", "af", "09"))
#: Matches that are put into one array one after another.
BLOCK = 256
_MOST = {k: int(1000 * WINDOW * (math.log2(WINDOW) - t)) for k, t in THRESHOLD.items()}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda inside asks for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, kind: str, place: int, group: int = 0, least: int = 0) -> Column:
    """Non-overlapping matches as structs (start, place, end, kind), those with a shorter ``group`` left out.

    Starts come from the lengths of the pieces between matches, so they count code points. Matches are gone through in
    blocks of BLOCK, so no long array is built one by one.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    none = "cast(array() as array<struct<start:int,place:int,end:int,kind:string,value:string>>)"
    rows = F.arrays_zip(pieces.alias("p"), found.alias("m"), tested.alias("t"))
    length = lambda row: F.length(row["p"]) + F.coalesce(F.length(row["m"]), F.lit(0))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["p"])
        end = state["at"] + length(row)
        one = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind).alias("kind"), row["m"].alias("value"))
        keep = row["m"].isNotNull() & (F.length(row["t"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    def block(rows: Column, at: Column) -> Column:
        return F.aggregate(rows, F.struct(at.alias("at"), F.expr(none).alias("out")), step)["out"]

    def in_blocks(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))

    def starts(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda rows: F.aggregate(rows, F.lit(0), lambda total, row: total + length(row)))
        every = F.aggregate(sums, F.array(F.lit(0)), lambda out, total: F.concat(out, F.array(F.element_at(out, -1) + total)))
        return F.slice(every, F.lit(1), F.size(blocks))

    spans = _let(rows, lambda rows: _let(in_blocks(rows), lambda blocks: _let(starts(blocks), lambda at: F.flatten(F.zip_with(blocks, at, block)))))
    return F.when(F.size(found) > 0, spans).otherwise(F.expr(none))


def _hot_runs(value: Column, by_window: bool) -> Column:
    """Runs of windows above the class's entropy within one candidate: structs (begin, end), from 0.

    With ``by_window`` a window of hex characters with both letters and digits has the hex bound in any candidate. One pass over the characters: the counts of the window and the sum of c * log2(c) change by the character
    that enters and the one that leaves.
    """
    most = F.when(value.rlike("^[0-9a-fA-F]+$"), _MOST["entropy_hex"]).otherwise(_MOST["entropy_base64"])
    terms = F.array(*[F.lit(t) for t in _TERMS])
    zero = F.expr(
        f"named_struct('counts', array_repeat(0, {len(ALPHABET)}), 'other', 0, 'digits', 0, 'sum', 0, 'i', 0, 'begin', -1, 'end', -1, "
        "'out', cast(array() as array<struct<begin:int,end:int>>))")

    # The character that leaves is the one WINDOW places back.
    rows = _let(F.split(value, ""), lambda chars: F.transform(chars, lambda c, i: F.struct(
        F.position(c, F.lit(ALPHABET)).alias("new"),
        F.when(i >= WINDOW, F.position(F.element_at(chars, F.greatest(i - WINDOW + 1, F.lit(1))), F.lit(ALPHABET))).otherwise(0).alias("old"))))

    digit = lambda c: c.between(*_DIGITS)
    no_hex = lambda c: (c > 0) & ~(c.between(*_UPPER) | c.between(*_LOWER) | digit(c))

    def slide(s: Column, r: Column) -> Column:
        had = F.element_at(s["counts"], r["new"])
        entered = s["sum"] - F.element_at(terms, had + 1) + F.element_at(terms, had + 2)
        left = F.element_at(s["counts"], F.greatest(r["old"], F.lit(1))) + F.when(r["old"] == r["new"], 1).otherwise(0)
        total = F.when(r["old"] > 0, entered - F.element_at(terms, left + 1) + F.element_at(terms, F.greatest(left, F.lit(1)))).otherwise(entered)
        counts = F.transform(s["counts"], lambda v, j: v + F.when(j + 1 == r["new"], 1).otherwise(0) - F.when(j + 1 == r["old"], 1).otherwise(0))
        i = s["i"] + 1
        other = s["other"] + no_hex(r["new"]).cast("int") - no_hex(r["old"]).cast("int")
        digits = s["digits"] + digit(r["new"]).cast("int") - digit(r["old"]).cast("int")
        mixed = (other == 0) & (digits > 0) & (digits < WINDOW)
        bound = F.when(mixed, F.greatest(most, F.lit(_MOST["entropy_hex"]))).otherwise(most) if by_window else most
        hot = (i >= WINDOW) & (total <= bound)
        joins = hot & (s["end"] >= i - WINDOW)
        closes = hot & ~joins & (s["end"] >= 0)
        run = F.struct(s["begin"].alias("begin"), s["end"].alias("end"))
        return F.struct(
            counts.alias("counts"), other.alias("other"), digits.alias("digits"), total.alias("sum"), i.alias("i"),
            F.when(hot & ~joins, i - WINDOW).otherwise(s["begin"]).alias("begin"),
            F.when(hot, i).otherwise(s["end"]).alias("end"),
            F.when(closes, F.concat(s["out"], F.array(run))).otherwise(s["out"]).alias("out"))

    def finish(s: Column) -> Column:
        run = F.struct(s["begin"].alias("begin"), s["end"].alias("end"))
        return F.when(s["end"] >= 0, F.concat(s["out"], F.array(run))).otherwise(s["out"])

    return F.aggregate(rows, zero, slide, finish)


def find_secrets(docs: DataFrame, by_window: bool = False) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of structs (start, place, end, kind), ordered, in code points.

    ``base`` holds assignments (value of 12 characters or more), access keys (18 or more) and hex strings (16
    or more), each kind leftmost and non-overlapping. ``added`` holds the runs of 20-character windows of
    other strings whose Shannon entropy reaches the bound of their class (hex, base64), unless an allow-list
    pattern fits the string or a base span covers the run. A string's class is that of all its characters, as in the SQL
    form; with ``by_window`` hex windows in longer strings (``md5=9F86...``) have the hex bound as well. Every step is a column expression on one row:
    nothing is shuffled and no Python runs on the executors. NULL and empty texts have no
    spans; repeated rows are judged alike; other columns stay as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_text", text)
    text = F.col("_text")
    spans = F.concat(_spans(text, "(?i)" + ASSIGN, "assign", 0, 2, 12), _spans(text, ACCESS, "access", 1, 0, 18), _spans(text, HEX, "hex", 2, 0, 16))
    rows = rows.withColumn("base", F.array_sort(F.transform(spans, lambda s: s.dropFields("value"))))
    rows = rows.withColumn("_found", F.filter(
        _spans(text, CANDIDATE, "entropy", 3), lambda s: ~F.exists(F.array(*[F.lit(a) for a in ALLOWED]), lambda a: F.regexp_like(s["value"], a))))

    def runs(s: Column) -> Column:
        place = F.when(s["value"].rlike("^[0-9a-fA-F]+$"), 3).otherwise(4)
        kind = F.when(place == 3, "entropy_hex").otherwise("entropy_base64")
        return F.transform(_hot_runs(s["value"], by_window), lambda r: F.struct(
            (s["start"] + r["begin"]).alias("start"), place.alias("place"), (s["start"] + r["end"]).alias("end"), kind.alias("kind")))

    inside = lambda r: F.exists("base", lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"]))
    none = F.expr("cast(array() as array<struct<start:int,place:int,end:int,kind:string>>)")
    added = F.when(F.size("_found") > 0, F.filter(F.flatten(F.transform("_found", runs)), lambda r: ~inside(r))).otherwise(none)
    return rows.withColumn("added", F.array_sort(added)).drop("_text", "_found")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_entropy_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(pick(read(spark, sf_dir, "documents"), doc_id="bigint", text="string"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def _sql_matches(kind: str, place: int, pattern: str, group: int = 0, least: int = 0) -> str:
    """SELECT of doc_id, start, place, stop, kind, value for each match of a pattern."""
    return f"""
SELECT doc_id, a - length(m) AS start, {place} AS place, a AS stop, '{kind}' AS kind, m AS value FROM (
  SELECT doc_id, m, t, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS a FROM (
    SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(ts) AS t, unnest(ps[1:len(ms)]) AS p FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS ts,
             string_split_regex(text, '{pattern}') AS ps FROM d))) WHERE length(t) >= {least}"""


_EITHER = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN_SQL = (_EITHER + ASSIGN[ASSIGN.index(")") + 1 :]).replace("'", "''")
_ALLOW_SQL = " AND ".join(f"NOT regexp_matches(value, '{a}')" for a in ALLOWED)
_ROWS_SQL = f"[{', '.join(map(str, _TERMS))}]"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_sql_matches("assign", 0, _ASSIGN_SQL, 2, 12)} UNION ALL {_sql_matches("access", 1, ACCESS, 0, 18)} UNION ALL {_sql_matches("hex", 2, HEX, 0, 16)}),
cand AS (SELECT *, regexp_matches(value, '^[0-9a-fA-F]+$') AS hexed FROM ({_sql_matches("entropy", 3, CANDIDATE)}) WHERE {_ALLOW_SQL}),
win AS (SELECT doc_id, start, hexed, p, substr(value, p + 1, {WINDOW}) AS w FROM (SELECT *, unnest(range(length(value) - {WINDOW - 1})) AS p FROM cand)),
hot AS (SELECT doc_id, start, hexed, p FROM win WHERE list_sum(list_transform(list_distinct(string_split(w, '')),
    lambda c: ({_ROWS_SQL})[{WINDOW} - length(replace(w, c, '')) + 1])) <= CASE WHEN hexed THEN {_MOST["entropy_hex"]} ELSE {_MOST["entropy_base64"]} END),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, start ORDER BY p) AS run FROM (
    SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, start ORDER BY p) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hot)),
runs AS (SELECT doc_id, start + min(p) AS start, CASE WHEN hexed THEN 3 ELSE 4 END AS place, start + max(p) + {WINDOW} AS stop,
    CASE WHEN hexed THEN 'entropy_hex' ELSE 'entropy_base64' END AS kind FROM isl GROUP BY doc_id, isl.start, hexed, run),
every AS (SELECT doc_id, start, place, stop, kind FROM base UNION ALL SELECT * FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start <= r.start AND b.stop >= r.stop)),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS b,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS s FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN agg USING (doc_id)
"""


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every found span, hex told by window, becomes ``[SECRET]``; texts without any stay as they are.

    Overlapping spans become one mark, and ``n_chars`` follows a changed text. Rows that share or lack an id are cut each by itself,
    repeated rows alike; NULL and empty texts stay. Other columns, and further ones of the same names, come back as they were; an
    empty table gives an empty result.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    rows = find_secrets(plain.withColumn("text", F.col(f"c{at}")), by_window=True)
    spans = F.array_sort(F.concat("base", "added"))
    text = F.col("text")

    def step(s: Column, r: Column) -> Column:
        fresh = r["start"] >= s["at"]
        piece = F.concat(F.substr(text, s["at"] + 1, F.greatest(r["start"] - s["at"], F.lit(0))), F.lit("[SECRET]"))
        return F.struct(F.greatest(s["at"], r["end"]).alias("at"), F.when(fresh, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<string>))")
    cut = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1)))
    rows = rows.withColumn("_hit", F.size(spans) > 0).withColumn("_cut", F.when(F.col("_hit"), cut))
    changed = {"text": F.col("_cut"), "n_chars": F.length("_cut")}
    return rows.select([
        (F.when(F.col("_hit"), changed[n]).otherwise(F.col(f"c{i}")) if n in changed and names.index(n) == i else F.col(f"c{i}")).alias(n)
        for i, n in enumerate(names)])
