"""Line-first quality rules, in one projection of built-in functions: no shuffle, no Python.

Each line is judged on its own: punctuation (shouting marks, symbol clutter, long lines without a sentence mark),
navigation (menus of separated items) and boilerplate (fixed phrases, as whole words, one or more for every ten words
of a short line). Failing lines are removed;
a document that loses more than half of its words so is rejected. Documents with too few words, or with too many
words inside repeated 8-word windows, are rejected before that.

Nulls and empty texts have no words and are rejected. Repeated rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
BOILERPLATE_WORDS = 30
WORDS_PER_PHRASE = 10
BETWEEN = r"[^\p{L}\p{N}_]"

# Fixed marks that end a sentence, in the scripts that have their own.
SENTENCE_MARKS = ".!?…。！？．｡؟۔।॥։።፧။។"

# Fixed phrases that mark a short line as boilerplate.
BOILERPLATE = [
    "accept all cookies", "add to cart", "all rights reserved", "back to top", "by using this site", "click here", "cookie policy",
    "create an account", "enable javascript", "follow us on", "forgot your password", "javascript is disabled", "leave a comment",
    "log in to", "lorem ipsum", "newsletter", "powered by", "privacy policy", "read more", "share on", "sign up for", "skip to content",
    "subscribe to", "terms of service", "terms of use", "this site uses cookies", "we use cookies",
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """The line rules; a line without words fails none."""
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    separators = F.regexp_count(line, F.lit(r"(?:^|[ ])[|»›·•>][ ]|[|]$"))
    navigation = (separators >= 3) & (separators * 2 >= n_words - separators)
    shouting = F.regexp_count(line, F.lit(r"[!?]{2,}")) * 10 >= n_words * 3
    clutter = F.regexp_count(line, F.lit(r"[#*$%&|<>{}~^=\\]{2,}")) * 10 >= n_words * 3
    no_sentence = (n_words >= 60) & (~line.rlike(f"[{SENTENCE_MARKS}]"))
    phrases = F.regexp_count(line, F.lit(rf"(?i)(?:^|{BETWEEN})(?:{'|'.join(BOILERPLATE)})(?:{BETWEEN}|$)"))
    boilerplate = (n_words <= BOILERPLATE_WORDS) & (phrases * WORDS_PER_PHRASE >= n_words)
    return (n_words > 0) & (navigation | shouting | clutter | no_sentence | boilerplate)


def _joined_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, the two verdicts and ``clean_text`` (failing lines removed) of each row; ``keep`` names columns to carry along, in the struct ``carried`` (their names may clash)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"), (F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)).alias("__keep"))
    a = base.select("*", words_of(F.col("__text")).alias("__words"), F.split(F.col("__text"), "\n", -1).alias("__lines"))
    b = a.select("*", F.size("__words").cast("long").alias("n_words"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"), F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__full"), F.transform("__lines", lambda x: line_fails(x)).alias("__bad"))
    windows = F.when(F.size("__h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__h", i, WINDOW))))
    c = b.select("*", windows.alias("__win"))
    repeated = F.size(F.array_distinct("__win")) < F.size("__win")
    placed = F.when(repeated, F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = c.select("*", placed.alias("__placed"))
    p = F.col("__placed")

    def twin(s: Column, j: Column) -> Column:
        before = (j > 0) & (F.get(p, j - 1)["h"] == s["h"])
        after = F.coalesce(F.get(p, j + 1)["h"] == s["h"], F.lit(False))
        return F.coalesce(before, F.lit(False)) | after

    starts = F.array_sort(F.transform(F.filter(p, twin), lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    kept_lines = F.filter("__lines", lambda x, i: ~F.get(F.col("__bad"), i))
    any_bad = F.exists("__bad", lambda x: x)
    e = d.select(
        "doc_id", "__keep", "n_words",
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.when(any_bad, _joined_lines(kept_lines)).otherwise(F.col("__text")).alias("clean_text"),
        any_bad.alias("__any"),
    )
    left = F.when(F.col("__any"), F.regexp_count("clean_text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).otherwise(F.col("n_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    f = e.select("*", left.alias("n_left"), failed.alias("base_failed"))
    lost = 100 * (F.col("n_words") - F.col("n_left")) > MAX_LOST_PERCENT * F.col("n_words")
    judged = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~lost).alias("kept"), "n_left", "clean_text"]
    # A generator keeps filters on these columns from being pushed down, where they'd be copied with all they are made of.
    return f.select(F.inline(F.array(F.struct(*judged, *[F.col("__keep").alias("carried") for _ in keep[:1]]))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


def keep_clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their failing lines; the columns of ``docs`` stay, ``n_chars`` follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    passed = assess(docs, keep=rest).filter("kept")
    made = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return passed.select(*[made[c].alias(c) if c in made else F.col("doc_id") if c == "doc_id" else F.col("carried")[c].alias(c) for c in docs.columns])
