"""Benchmark decontamination by canonical templates, with DataFrame functions alone.

Numbers, names and units become typed placeholders, so that a question with other parameters has the same template.
Windows of a few template tokens of every document are hash-joined with those of the benchmark items; an alignment found
so is compared token by token, with the slots' values. Along one alignment (document position less item position) each
value of the item must stand for one value of the document, else the alignment is not a re-parameterised copy and counts
for nothing. A document is contaminated by an item if the windows of its consistent alignments cover ``min_share`` of the item's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import fresh_names

#: Placeholders; the first character is a letter (U+01C1) that ordinary text lacks.
NUM, NAME, UNIT = "ǁnum", "ǁname", "ǁunit"
#: Joins the parts of a decimal number in one token.
POINT = "ǂ"
#: Unit words that follow a number; a parameter.
UNITS = (
    "mm cm m km g kg mg t l ml s h min ms hz khz mhz ghz w kw v a j kj pa n k c f mph kmh "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards "
    "gram grams kilogram kilograms kilo kilos ton tons tonne tonnes pound pounds ounce ounces liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur percent degree degrees"
).split()


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def _joined(text: Column) -> Column:
    return F.when(text.rlike("[0-9][.,][0-9]"), F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", POINT)).otherwise(text)


def _raw(text: Column) -> Column:
    return _split(F.lower(_joined(text)))


def _canonical(text: Column, units: list[str]) -> Column:
    """Template tokens, aligned one to one with the raw ones."""
    low = F.lower(F.regexp_replace(_joined(text), r" (?<=[\p{L}\p{N},;] )\p{Lu}[\p{L}\p{N}]*", " " + NAME))
    numbered = F.regexp_replace(low, rf"(?<![\p{{L}}\p{{N}}])[0-9][0-9{POINT}]*(?![\p{{L}}\p{{N}}])", NUM)
    united = F.regexp_replace(numbered, rf"(?<={NUM}[^\p{{L}}\p{{N}}]{{1,3}})(?:{'|'.join(units)})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.when(low.rlike("[0-9]"), _split(united)).otherwise(_split(low))


def _hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _windows(hashes: Column, n: int, step: int, kind: int) -> Column:
    """(n, pos, h) of the windows of ``n`` tokens at every ``step``, from the column of the tokens' hashes; null without one.

    ``kind`` goes into each hash, so that windows of one kind only meet their own. The hashes must be a column of an earlier
    projection: inside the lambda an expression would run again each time.
    """
    places = F.sequence(F.lit(0), F.size(hashes) - n, F.lit(step))
    one = lambda i: F.struct(F.lit(kind).alias("n"), i.alias("pos"), F.xxhash64(F.lit(kind), *[F.get(hashes, i + k) for k in range(n)]).alias("h"))
    return F.when(F.size(hashes) >= n, F.transform(places, one))


def _all_windows(hashes: Column, kinds: list[tuple[int, int, int]]) -> Column:
    """Of each kind (n, gram, step), in one array."""
    return F.flatten(F.filter(F.array(*[_windows(hashes, gram, step, n) for n, gram, step in kinds]), lambda w: w.isNotNull()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 5, min_share: float = 0.5, max_broadcast: int = 500_000, units: list[str] = UNITS, names: list[str] | None = None) -> DataFrame:
    """Pairs of documents and the items they leak: a row key (id, hash and length of the text, under ``names``), item_id, share.

    Items shorter than a window are one window of their own length. Items without tokens match nothing.
    A window at any position holds a gram of one token less at an even one: documents look up those grams at every
    second position, and the alignments that they give are compared whole. Each document is read, and made canonical, once.
    With up to ``max_broadcast`` tokens in all (some 60 bytes each with their windows) the benchmark is broadcast. With
    more, bare windows are joined by shuffles, and a document's text is fetched once for all that it met.
    """
    doc = names or fresh_names(docs, "id", "hash", "len")
    text = F.coalesce(F.col("text"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).distinct()
    items = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), _raw(F.col("text")).alias("iraw"), _canonical(F.col("text"), units).alias("itok"))
    items = items.filter("size(itok) > 0").withColumn("n", F.when(F.size("itok") < window, F.size("itok")).otherwise(F.lit(window)))
    sizes = items.groupBy("n").agg(F.sum(F.size("itok")).alias("tokens")).collect()  # a row for each length up to a window
    if not sizes:
        return docs.select(*_row_key(doc), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("share")).limit(0)
    small = sum(r.tokens for r in sizes) <= max_broadcast
    kinds = [(n, n - 1, 2) if n == window > 2 else (n, n, 1) for n in sorted(r.n for r in sizes)]
    # the values of slots are only looked up where some item has a slot
    slotted = not items.filter(F.exists("itok", lambda t: F.substring(t, 1, 1) == NUM[0])).isEmpty()
    rows = docs.select(*_row_key(doc), text.alias("text"), _canonical(text, units).alias("tokens")).withColumn("hashes", _hashes("tokens"))
    rows = rows.withColumn("raw", _raw(F.col("text")) if slotted else F.lit(None).cast("array<string>"))
    side = None
    for n, gram, _ in kinds:
        own = items.filter(F.col("n") == n).withColumn("hashes", _hashes("itok")).select("item", F.explode_outer(_windows(F.col("hashes"), gram, 1, n)).alias("w"))
        side = own if side is None else side.unionByName(own)
    side = side.select("item", F.col("w.pos").alias("ipos"), F.col("w.h").alias("h"))
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("shuffle_merge"))
    windows = rows.select("*", F.explode_outer(_all_windows(F.col("hashes"), kinds)).alias("w"))
    diag = F.col("pos") - F.col("ipos")
    if small:
        windows = windows.select(*doc, "raw", "tokens", F.col("w.pos").alias("pos"), F.col("w.h").alias("h"))
        pairs = windows.join(held(side), "h").withColumn("diag", diag)
    else:
        met = windows.select(*doc, F.col("w.pos").alias("pos"), F.col("w.h").alias("h")).join(held(side), "h")
        met = met.select(*doc, "item", diag.alias("diag")).distinct()
        pairs = met.join(rows.select(*doc, "raw", "tokens").dropDuplicates(doc), doc)
    # of the document only what the item lies on, once an alignment: a long text that meets it everywhere is not copied each time
    skip = F.greatest(-F.col("diag"), F.lit(0))
    cut_out = lambda c: F.slice(c, F.greatest("diag", F.lit(0)) + 1, F.col("size") - skip)
    pairs = pairs.join(held(items.select("item", F.size("itok").alias("size"))), "item").select(*doc, "item", "diag", cut_out("tokens").alias("tokens"), cut_out("raw").alias("raw"))
    pairs = pairs.groupBy(*doc, "item", "diag").agg(F.first("tokens").alias("tokens"), F.first("raw").alias("raw"))  # all are equal
    pairs = pairs.join(held(items), "item").withColumn("skip", skip)
    n = F.col("n")
    places = F.sequence(F.lit(0), F.size("itok") - 1)
    equal = F.transform(places, lambda j: F.coalesce((j >= F.col("skip")) & (F.get("tokens", j - F.col("skip")) == F.get("itok", j)), F.lit(False)))
    pairs = pairs.withColumn("equal", equal).filter("size(equal) > 0")  # a second use: the column stays one
    at = F.filter(F.slice(places, F.lit(1), F.size("itok") - n + 1), lambda i: F.forall(F.slice("equal", i + 1, n), lambda x: x))
    pairs = pairs.withColumn("at", at)
    in_slot = lambda j: (F.substring(F.get("itok", j), 1, 1) == NUM[0]) & F.exists("at", lambda i: (i <= j) & (j < i + n))
    slot = lambda j: F.struct(F.struct(F.get("itok", j).alias("kind"), F.get("iraw", j).alias("value")).alias("i"), F.get("raw", j - F.col("skip")).alias("d"))
    slots = F.array_distinct(F.transform(F.filter(places, in_slot), slot))
    aligned = pairs.filter("size(at) > 0").select(*doc, "item_id", "item", (F.size("itok") - n + 1).alias("of"), "diag", "at", slots.alias("slots"))
    keys = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    per_item = aligned.filter(keys == F.size("slots")).groupBy(*doc, "item_id", "item", "of").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"))
    shares = per_item.select(*doc, "item_id", (F.col("n") / F.col("of")).alias("share")).filter(F.col("share") >= min_share)
    return shares.groupBy(*doc, "item_id").agg(F.max("share").alias("share"))


def _row_key(names: list[str]) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text), F.length(text)]
    return [p.alias(n) for p, n in zip(parts, names)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Adds ``contaminated, n_items, items, share`` (the largest) to each document.

    Null and empty texts are clean. An empty benchmark makes all clean. Rows are told apart by id and text; repeated
    rows get equal results. Benchmark items that repeat an item_id count as one item's windows each. Added names are
    replaced.
    """
    docs = docs.drop("contaminated", "n_items", "items", "share")
    names = fresh_names(docs, "id", "hash", "len")
    leaks = find_leaks(docs, benchmark, names=names, **options)
    per_doc = leaks.groupBy(*names).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("share"))
    joined = docs.select("*", *_row_key(names)).join(per_doc, names, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )
