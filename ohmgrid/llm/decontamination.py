"""Benchmark decontamination by template windows (operator 5). DataFrame functions only.

Numbers, names and units become typed placeholders; windows of the resulting
words are hashed and joined with those of the benchmark. A document matches an
item where runs of windows near each other hold enough of its words, or one run
is long, and the placeholders' values map consistently in each run, so questions
whose parameters were changed are found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, forget, once, table, text_or_empty, using, written

#: Placeholders: private-use characters, which are no part of a word otherwise.
NUMBER, NAME, UNIT = map(chr, range(0xE000, 0xE003))
PLACES = NUMBER + NAME + UNIT
UNITS = (
    "km|m|cm|mm|kg|g|mg|t|l|ml|ha|mph|kmh|mile|miles|foot|feet|inch|inches|hour|hours|minute|minutes|second|seconds|"
    "day|days|week|weeks|month|months|year|years|dollar|dollars|euro|euros|pound|pounds|usd|eur|percent|degrees|"
    "stunde|stunden|tage|jahre|heures|jours|ans|horas|días|años"
)
#: Words of a window, and of an item below which its values must be the same as well.
WINDOW, LEAST_WORDS = 8, 5
#: Words of a run that match whatever share of the item they are.
LONG_RUN = 13
#: Benchmark windows (about 100 bytes each), or documents with hits, up to which their table is broadcast; beyond, the join shuffles.
MOST_BROADCAST = 200_000


def raw_words(text: Column) -> Column:
    """Lower-cased words of letters and digits, other signs deleted; one for one with ``template``."""
    return _split(F.lower(text))


def template(text: Column) -> Column:
    """Words with numbers, names in mid-sentence, and units after a number as placeholders."""
    t = F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll},;:] \p{Lu})\p{Ll}+", NAME)
    t = F.lower(F.regexp_replace(t, r"[0-9]+(?:[.,:/][0-9]+)*+", NUMBER))
    t = F.regexp_replace(t, rf"{NUMBER}( ?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}")
    return _split(t)


def _split(text: Column) -> Column:
    t = F.btrim(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{PLACES}\s]+", ""), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+", -1))


def windows(words: Column, size: int) -> Column:
    """Array of hashes: one for each window of ``size`` words."""
    n = F.size(words) - (size - 1)
    return F.when(n > 0, F.transform(F.slice(words, F.lit(1), n), lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, size)])))


def benchmark_windows(items: DataFrame, size: int, only: int | None) -> DataFrame:
    """Windows of the items: hash, item, place, raw and template words, windows per item."""
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", text_or_empty().alias("text"))
    rows = rows.withColumn("__t", once(template(F.col("text")))).withColumn("__r", once(raw_words(F.col("text"))))
    rows = rows.where(F.size("__t") >= size if only is None else F.size("__t") == only)
    rows = rows.select("item_id", "__t", "__r", once(windows(F.col("__t"), size)).alias("__h"))
    rows = rows.select("item_id", F.size("__h").alias("n_windows"), "__t", "__r", F.posexplode("__h").alias("ipos", "h"))
    raw, temp = F.slice("__r", F.col("ipos") + 1, size), F.slice("__t", F.col("ipos") + 1, size)
    marks = F.transform(temp, lambda x: x.rlike(f"[{PLACES}]"))
    return rows.select("h", "item_id", "ipos", "n_windows", F.when(F.array_contains(marks, True), F.struct(raw.alias("raw"), marks.alias("marks"))).alias("slots"))


def matches(df: DataFrame, items: DataFrame, size: int, text: str) -> DataFrame:
    """Windows of documents that an item has: doc_id, __alt, item_id, diagonal, ipos, n_windows, size, pairs.

    ``pairs``: values of the window's placeholders, in the item and the document.
    Items of fewer than ``size`` words have one window, so documents' windows of
    just those lengths that occur are hashed beside those of ``size``. Only the
    place and the hash of a window meet the benchmark; the words of documents
    with hits are read afterwards, once for each document.
    """
    lengths = items.where(F.col("item_id").isNotNull()).select(F.size(template(text_or_empty())).alias("n"))
    short = sorted(r[0] for r in lengths.where((F.col("n") > 0) & (F.col("n") < size)).distinct().collect())
    bench = benchmark_windows(items, size, None).withColumn("size", F.lit(size))
    for n in short:
        bench = bench.unionByName(benchmark_windows(items, n, n).withColumn("size", F.lit(n)))
    bench = written(bench, "benchmark-windows")
    small = bench.count() <= MOST_BROADCAST
    body = text_or_empty(text)
    ids = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.md5(body)).alias("__alt"), F.xxhash64(body).alias("__text")]
    docs = df.select(*ids, once(template(body)).alias("__t"))

    def places(n: int) -> Column:
        return F.transform(windows(F.col("__t"), n), lambda h, i: F.struct(h.alias("h"), i.alias("dpos"), F.lit(n).alias("size")))

    if short:
        empty = F.array().cast("array<struct<h:bigint,dpos:int,size:int>>")
        found = docs.select("doc_id", "__alt", "__text", F.explode(once(F.concat(*[F.coalesce(places(n), empty) for n in (size, *short)]))).alias("x")).select("doc_id", "__alt", "__text", "x.*")
    else:
        docs = docs.withColumn("__h", once(windows(F.col("__t"), size)))
        found = docs.select("doc_id", "__alt", "__text", F.posexplode("__h").alias("dpos", "h")).withColumn("size", F.lit(size))
    hits = written(found.join(F.broadcast(bench) if small else bench, ["h", "size"]).drop("h"), "window-hits")
    named = written(hits.where("slots is not null").select("doc_id", "__alt", "__text").distinct(), "window-documents")
    named_ = F.broadcast(named) if named.count() <= MOST_BROADCAST else named
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.__alt").eqNullSafe(F.col(f"{b}.__alt")) & (F.col(f"{a}.__text") == F.col(f"{b}.__text"))
    words = df.select(*ids, body.alias("body")).alias("d").join(named_.alias("n"), same("d", "n"), "left_semi")
    words = words.groupBy("doc_id", "__alt", "__text").agg(F.first("body").alias("body")).select("doc_id", "__alt", "__text", once(raw_words(F.col("body"))).alias("words"))
    whole = hits.alias("h").join(words.alias("w"), same("h", "w") & F.col("h.slots").isNotNull(), "left").select("h.*", "w.words")
    own = F.slice("words", F.col("dpos") + 1, F.col("size"))
    pairs = F.filter(
        F.zip_with(F.arrays_zip(F.col("slots.raw").alias("raw"), F.col("slots.marks").alias("marks")), own, lambda a, b: F.struct(a["raw"].alias("item"), b.alias("doc"), a["marks"].alias("mark"))),
        lambda p: p["mark"],
    )
    out = whole.select("doc_id", "__alt", "item_id", (F.col("dpos") - F.col("ipos")).alias("diagonal"), "ipos", "n_windows", "size", F.when(F.col("slots").isNotNull(), pairs).alias("pairs"))
    return using(out, bench, hits, named)


def contaminated(df: DataFrame, items: DataFrame, coverage: float = 0.5, size: int = WINDOW, text: str = "text", long_run: int = LONG_RUN) -> DataFrame:
    """A row per (document, item) that match: doc_id, item_id, n_windows, matched, coverage, n_slots, n_changed, run_words.

    ``df``: doc_id, text; ``items``: item_id, text. A run is a stretch of the
    item's windows that follow each other in the document as well; in a run each
    value of a placeholder in the item must stand for one value in the document.
    Runs no farther apart in the document than the item is long are added up,
    on whatever diagonals they lie, so inserted, deleted and replaced words do
    not hide a copy. They match if they hold at least the share ``coverage`` of
    the item's words, each word of either side counted once. A run of
    ``long_run`` words matches whatever share of the item it is, if ``size`` of
    them at least are not changed values; so does a stretch of that length with
    no changed value within a run whose values contradict each other.
    Items of fewer than ``size`` words are one window as a whole; of fewer than
    ``LEAST_WORDS``, they match only with the same values. Items without words or
    with a null id are left out, null and empty texts match nothing, and very
    long ones are looked through whole. Rows that share a doc_id are one
    document; a null doc_id is kept apart by its text (column ``__alt``). Of runs
    that hold equally many words the longer one, then the first is reported. An
    empty table on either side gives an empty result, and other columns are not
    read, whatever their names. Only documents' windows that meet the benchmark
    are shuffled, so a passage that a third of all documents quote moves a few
    rows per document, spread by document.
    """
    hits = matches(df, items, size, text)
    found = clusters(runs(hits, size, long_run))
    found = found.where(F.col("long") | (F.col("words") >= coverage * F.col("n_words")))
    values = F.col("pairs")
    found = found.where((F.col("n_words") >= LEAST_WORDS) | ~F.exists(values, lambda p: ~p["item"].eqNullSafe(p["doc"])))
    best = found.groupBy("doc_id", "__alt", "item_id").agg(
        F.max_by(
            F.struct("n_windows", "matched", (F.col("words") / F.col("n_words")).alias("coverage"), F.size(values).alias("n_slots"), F.size(F.filter(values, lambda p: p["item"] != p["doc"])).alias("n_changed"), "run_words"),
            F.struct("words", "run_words", "matched", -F.col("dstart")),
        ).alias("b")
    )
    counts = [F.col(f"b.{c}").cast("double" if c == "coverage" else "long").alias(c) for c in ("n_windows", "matched", "coverage", "n_slots", "n_changed", "run_words")]
    return using(best.select("doc_id", "__alt", "item_id", *counts), hits)


def runs(hits: DataFrame, size: int, long_run: int) -> DataFrame:
    """Runs of windows on one diagonal with consistent values: first and last window, slots, ``long``."""
    line = ["doc_id", "__alt", "item_id", "diagonal"]
    along = Window.partitionBy(*line).orderBy("ipos", "same")
    hits = hits.withColumn("same", ~F.exists(F.coalesce("pairs", F.array().cast(hits.schema["pairs"].dataType)), lambda p: ~p["item"].eqNullSafe(p["doc"])))
    apart = F.coalesce(F.col("ipos") - F.lag("ipos").over(along) > 1, F.lit(True))
    turns = apart | (F.col("same") != F.lag("same").over(along))
    hits = hits.withColumns({"__apart": apart.cast("int"), "__turns": turns.cast("int")})
    hits = hits.withColumns({"run": F.sum("__apart").over(along), "stretch": F.sum("__turns").over(along)})
    pieces = hits.groupBy(*line, "run", "stretch", "same", "n_windows", "size").agg(F.min("ipos").alias("first"), F.max("ipos").alias("last"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    copied = F.max(F.when(F.col("same"), F.struct((F.col("last") - F.col("first")).alias("n"), F.col("first"), F.col("last"), F.col("pairs")))).alias("copied")
    out = pieces.groupBy(*line, "run", "n_windows", "size").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), copied)
    changed = F.size(F.filter("pairs", lambda p: ~p["item"].eqNullSafe(p["doc"])))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))) == F.size("pairs")
    words = F.col("last") - F.col("first") + F.col("size")
    long_copy = F.coalesce(F.col("copied.n") + F.col("size") >= long_run, F.lit(False))
    out = out.withColumns({"__ok": consistent, "long": F.when(consistent, (words >= long_run) & (words - changed >= size)).otherwise(False) | long_copy}).where(F.col("__ok") | F.col("long"))
    # of a run with contradicting values only the copied stretch counts
    part = {c: F.when(F.col("__ok"), F.col(c)).otherwise(F.col(f"copied.{c}")) for c in ("first", "last", "pairs")}
    return out.withColumns(part).drop("run", "copied", "__ok")


def clusters(found: DataFrame) -> DataFrame:
    """Runs of an item that are near each other in the document, added up: windows and words counted once."""
    key = ["doc_id", "__alt", "item_id"]
    shift = F.col("diagonal")
    found = found.withColumns({"n_words": F.col("n_windows") + F.col("size") - 1, "run_words": F.col("last") - F.col("first") + F.col("size"), "dstart": F.col("first") + shift, "dend": F.col("last") + shift + F.col("size")})
    order = Window.partitionBy(*key).orderBy("dstart", "dend", "first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("__past", F.max("dend").over(before))
    found = found.withColumn("__far", F.coalesce(F.col("dstart") - F.col("__past") > F.col("n_words"), F.lit(True)).cast("int"))
    found = found.withColumn("cluster", F.sum("__far").over(order))
    found = found.withColumn("__dnew", F.greatest(F.lit(0), F.col("dend") - F.greatest("dstart", F.coalesce("__past", "dstart"))))
    inside = Window.partitionBy(*key, "cluster").orderBy("first", "last", "dstart").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("__seen", F.coalesce(F.max("last").over(inside), F.lit(-(1 << 30))))
    # windows first..last hold the words first..last + size - 1
    found = found.withColumn("__inew", F.greatest(F.lit(0), F.col("last") + F.col("size") - F.greatest("first", F.col("__seen") + F.col("size"))))
    found = found.withColumn("__wnew", F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.col("__seen"))))
    return found.groupBy(*key, "cluster", "n_windows", "n_words").agg(
        F.least(F.sum("__inew"), F.sum("__dnew")).alias("words"), F.sum("__wnew").alias("matched"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        F.bool_or("long").alias("long"), F.max("run_words").alias("run_words"), F.min("dstart").alias("dstart"),
    )


def decontaminate(df: DataFrame, items: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``df`` that match no item, with the columns of ``df``.

    The found documents are written first; the texts are then filtered against
    that small table, by broadcast where its size allows. See ``contaminated``
    for nulls, repeats, long texts and empty tables.
    """
    hits = contaminated(df.select("doc_id", "text"), items, **limits)
    found = written(hits.select(F.col("doc_id").alias("__id"), "__alt").distinct(), "contaminated")
    forget(hits)
    alt = F.md5(text_or_empty())
    clean = df.join(found.where("__id is not null").select("__id"), F.col("doc_id") == F.col("__id"), "left_anti")
    nameless = found.where("__id is null").select(F.col("__alt").alias("__alt2"))
    return using(clean.join(nameless, F.col("doc_id").isNull() & (alt == F.col("__alt2")), "left_anti"), found)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("__alt")
