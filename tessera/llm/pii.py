"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Base kinds (email, ip, card, phone) are found by their patterns. They are the seeds: the words around them are lexical
patterns. Identifier-shaped words (digits or quotes with letters, key-like strings) are instances; pattern-instance pairs
form a graph with counts. A few rounds score patterns by the share of their weight on trusted instances and instances
by the trust of the patterns they stand in; instances in confident patterns are new identifiers, and add to the spans.
Key-value pairs with a secret's name are trusted from the start, so are seeds.

Spans are code points, end exclusive. Positions come from the lengths of matches and of the gaps between them.

Nulls and empty texts have no spans. Repeated rows give equal rows. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash

# Fixed patterns of the base kinds. Runs are possessive and start only where a run starts (or the last match ended),
# which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Identifier-shaped words: key-like strings of 16 or more with digits and letters, and long numbers with separators.
INSTANCE = r'(?<![A-Za-z0-9_@.+/-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{8,}+(?![A-Za-z0-9_@]|\.[A-Za-z0-9])'
INSTANCE_GATE = r"[A-Za-z0-9_-]{8}"
CONTEXT_WORDS = 2
ROUNDS = 3
MIN_PATTERN_SCORE = 0.5
MIN_INSTANCES = 2
# Fixed names of secrets; a value assigned to one is a seed. They are read with marks (as in api_key) turned into spaces.
SECRET_NAMES = r"(?i)(?:token|secret|password|passwd|api ?key|access ?key|auth|bearer|ssn|passport|iban|account)"

CONTEXT_CHARS = 80
KINDS = tuple(PATTERNS)
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _placed(values: Column, gaps: Column) -> Column:
    """Matches as (start, end, value): each starts where the gap before it ends. Both must be columns of a child plan."""
    empty = F.lit([]).cast(_SPAN)
    return F.aggregate(
        F.sequence(F.lit(0), F.size(values) - 1),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, i: F.struct(
            (acc["at"] + F.char_length(F.get(gaps, i)) + F.char_length(F.get(values, i))).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.char_length(F.get(gaps, i))).alias("start"), (acc["at"] + F.char_length(F.get(gaps, i)) + F.char_length(F.get(values, i))).alias("end"), F.get(values, i).alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(digits, -i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, -i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(F.col(kind), lambda m: _holds(kind, m["value"]))


def _of_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table ``(row, doc_id, text_hash, email, ip, card, phone, instances)``: the base spans of each row and its
    identifier-shaped words, each with its left context and whether it is a seed."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    patterns, gates = PATTERNS | {"shaped": INSTANCE}, GATES | {"shaped": INSTANCE_GATE}
    t = F.col("t")
    a = source.select("*", *[F.when(t.rlike(gates[k]), F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias(f"v_{k}") for k, p in patterns.items()])
    b = a.select("*", *[F.when(F.size(f"v_{k}") > 0, F.split(t, p, -1)).alias(f"g_{k}") for k, p in patterns.items()])
    c = b.select("doc_id", "t", *[F.when(F.size(f"v_{k}") > 0, _placed(F.col(f"v_{k}"), F.col(f"g_{k}"))).otherwise(F.lit([]).cast(_SPAN)).alias(k) for k in patterns])
    d = c.select("doc_id", "t", *[_checked(k).alias(k) for k in KINDS], "shaped")
    base = F.concat(*[F.col(k) for k in KINDS])
    loose = F.filter("shaped", lambda m: ~F.exists(F.concat(*[F.col(k) for k in KINDS]), lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"])))
    e = d.select("doc_id", "t", *KINDS, base.alias("base"), loose.alias("loose"))

    def with_context(m: Column, seed: Column) -> Column:
        before = F.substring(F.col("t"), F.greatest(m["start"] - (CONTEXT_CHARS - 1), F.lit(1)), F.least(m["start"], F.lit(CONTEXT_CHARS)))
        plain = F.regexp_replace(F.lower(before), r"[^\p{L}\p{N}:=]+", " ")  # marks between the words are no part of a pattern
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), plain.alias("before"), seed.alias("seed"))

    seeds = F.transform("base", lambda m: with_context(m, F.lit(True)))
    named = F.transform("loose", lambda m: with_context(m, F.lit(False)))
    f = e.select("doc_id", F.xxhash64("t").alias("text_hash"), *KINDS, F.concat(seeds, named).alias("instances"))
    secret = rf"{SECRET_NAMES} ?[:=] ?\z"  # on all that stands before: a name may have more words than a context

    def judged(m: Column) -> Column:
        context = F.regexp_extract(m["before"], rf"((?:\S+ ){{0,{CONTEXT_WORDS - 1}}}\S+) ?\z", 1)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), context.alias("context"), (m["seed"] | m["before"].rlike(secret)).alias("seed"))

    g = f.select("doc_id", "text_hash", *KINDS, F.transform("instances", judged).alias("instances"))
    return stash(g.select(F.monotonically_increasing_id().alias("row"), "*"), "found")


def score_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(context, score, support)``: the graph of contexts and values, scored in turn.

    A context's score is the trust of its distinct values over their number plus one; a value is trusted if it is a
    seed, else as much as the mean of its contexts. Counts are pre-aggregated, so frequent contexts cost one row a task.
    """
    each = found.select(F.explode("instances").alias("m")).select("m.context", F.xxhash64("m.value").alias("value"), F.col("m.seed").cast("int").alias("seed")).filter("context <> ''")
    pairs = stash(each.groupBy("context", "value").agg(F.max("seed").alias("seed")), "pairs")
    trust = pairs.groupBy("value").agg(F.max("seed").cast("double").alias("trust"), F.max("seed").alias("is_seed"))
    for _ in range(rounds):
        scored = pairs.join(trust, "value").groupBy("context").agg((F.sum("trust") / (F.count(F.lit(1)) + 1)).alias("score"), F.count(F.lit(1)).alias("support"))
        scored = stash(scored, "patterns")
        trust = pairs.join(scored, "context").groupBy("value").agg(F.greatest(F.max("seed").cast("double"), F.avg("score")).alias("trust"))
    return scored


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, counts of the base kinds, their digest, ``spans`` and the array ``all_spans``
    of (kind, start, end) by kind and start. Found identifiers have the kind ``id``."""
    found = find(docs, id_col, text_col)
    confident = score_patterns(found).filter((F.col("score") >= MIN_PATTERN_SCORE) & (F.col("support") >= MIN_INSTANCES)).select("context")
    free = found.select("row", F.explode("instances").alias("m"), *KINDS).filter(~F.exists(F.concat(*[F.col(k) for k in KINDS]), lambda x: (x["start"] == F.col("m")["start"]) & (x["end"] == F.col("m")["end"])))
    rows = free.select("row", "m.context", "m.start", "m.end", "m.seed")
    named = rows.filter("seed").select("row", "start", "end")
    learnt = rows.filter("not seed").join(confident, "context").select("row", "start", "end")
    ids = named.unionByName(learnt).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ids"))
    joined = found.join(ids, "row", "left")
    parts = [_of_kind(k, F.col(k)) for k in KINDS]
    more = _of_kind("id", F.coalesce(F.col("ids"), F.lit([]).cast("array<struct<start:int,end:int>>")))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")

    out = joined.select("doc_id", "text_hash", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*parts).alias("base"), F.concat(*parts, more).alias("all_spans"))
    return out.select("doc_id", "text_hash", *[f"n_{k}" for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("all_spans")).alias("spans"), F.size("all_spans").cast("long").alias("n_spans"), "all_spans")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "all_spans")


def redact(docs: DataFrame) -> DataFrame:
    """Documents with each span replaced by its kind in brackets; overlapping spans become one. Others stay as they are.

    The columns of ``docs`` stay, whatever their names; ``n_chars``, where there is one, follows the text. Rows travel as structs.
    """
    spans = extract(docs).filter(F.size("all_spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("all_spans").alias("spans")).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    joined = rows.join(spans, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    text = F.col("row")["text"]
    ordered = F.array_sort(F.transform("spans", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    steps = joined.select("row", F.col("spans").isNotNull().alias("hit"), ordered.alias("ordered"))
    cut = F.aggregate(
        "ordered",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, m: F.struct(
            F.when(m["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), F.lit("["), m["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], m["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2147483647))),
    )
    done = steps.select("row", "hit", F.when(F.col("hit"), cut).otherwise(text).alias("new"))
    made = {"text": F.col("new"), "n_chars": F.when(F.col("hit"), F.char_length("new").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return done.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])
