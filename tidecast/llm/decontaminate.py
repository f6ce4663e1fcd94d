"""Benchmark decontamination by template canonicalisation.

Texts become sequences of words in lower case in which numbers, names and units are typed
placeholders. Windows of eight words are joined by hash to the benchmark's windows, so that a question
with other numbers and names still meets its original. What stands in the placeholders is kept as
slots: where along one alignment a value of the question turns into several values of the document,
the windows that change it do not count, while windows that match word for word always do. A document
leaks an item if the windows that count cover at least half of the item's. Windows with few literal
words meet only with the same words in the placeholders, and shorter items are one window.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import broadcast_up_to
from tidecast.staging import stage

WINDOW = 8
# Windows of fewer words that are no placeholders are compared with their placeholders' words.
MIN_LITERALS = 4
MIN_SHARE = 0.5
# Benchmark windows that may be broadcast; larger benchmarks are joined by a shuffle.
MOST_WINDOWS = 500_000
# Leaking documents whose ids may be broadcast.
MOST_LEAKS = 1_000_000
# Items of fewer words stay reported, but cost no document its place.
LEAST_WORDS = 4
UNITS = (
    "km m cm mm mi ft yd in kg g mg lb lbs oz t l ml cl gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "kmh mph w kw kwh j v hz mb gb tb px percent usd eur gbp dollars euros pounds cents meter meters metre metres kilometers kilometres miles inches feet grams kilograms liters litres").split()

# Marks put before names, and between the digits of one number; no pattern looks around, so SQL can state them.
_NAME, _POINT = "\x01", "\x02"
_NAME_AFTER, _CAPITAL = r"([\p{Ll}\p{N},;:)] )(\p{Lu}\p{Ll}+)", r"(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll}+)"
_BETWEEN = rf"[^\p{{L}}\p{{N}}{_NAME}{_POINT}]+"


def words(text: Column, inside: bool = False) -> Column:
    """Words in lower case; a capitalised word has the name mark before it, with ``inside`` only inside a sentence."""
    text = F.coalesce(text, F.lit(""))
    numbers = F.regexp_replace(F.regexp_replace(text, r"([0-9])[.,]([0-9])", rf"$1{_POINT}$2"), r"([0-9])(\p{L})", "$1 $2")
    text = F.when(text.rlike("[0-9]"), numbers).otherwise(text)
    # A match takes the letter before it, so the second pass marks every other name of a run.
    for pattern in [_NAME_AFTER, _NAME_AFTER] if inside else [_CAPITAL]:
        text = F.regexp_replace(text, pattern, rf"$1{_NAME}$2")
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def _templates(texts: DataFrame, keys: list[str], least: int, inside: bool) -> DataFrame:
    """(keys, h, slots) of texts (keys, text) with at least so many words: a hash per word, 1 to 3 for placeholders, and the words behind placeholders."""
    is_number = lambda x: (x >= "0") & (x < ":")
    is_unit = lambda x, i: (i > 0) & is_number(F.get("words", i - 1)) & x.isin(UNITS)
    template = F.transform("words", lambda x, i: F.when(x < "0", F.lit(1)).when(x < ":", F.lit(2)).when(is_unit(x, i), F.lit(3)).otherwise(F.xxhash64(x)))
    slots = F.transform("words", lambda x, i: F.when((x < ":") | is_unit(x, i), x))
    seen = texts.select(*keys, words(F.col("text"), inside).alias("words"))
    return seen.where(F.size("words") >= least).select(*keys, template.alias("h"), F.when(F.exists("words", lambda x: x < ":"), slots).alias("slots"))


def _starts(length: int, own: bool) -> Column:
    n = F.size("h")
    fits = n == length if own and length < WINDOW else n >= length
    return F.when(fits, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _shape(i: Column, length: int) -> Column:
    """The hash of the template window at ``i``."""
    return F.xxhash64(*[F.get("h", i + k) for k in range(length)])


def windows(texts: DataFrame, keys: list[str], lengths: Iterable[int] = (WINDOW,), own: bool = False, inside: bool = False) -> DataFrame:
    """(keys, shape, pos, length, slots, key): the windows of so many words of the texts (keys, text).

    slots has the window's words where placeholders are and null elsewhere; it is null itself where
    the window has no placeholder. key is the shape, in windows of few literal words with the words of the slots.
    With ``own`` a window shorter than WINDOW must be the whole text.
    """
    def of(length: int) -> Column:
        part = lambda i: F.slice("slots", i + 1, F.lit(length))
        return F.transform(_starts(length, own), lambda i: F.struct(
            _shape(i, length).alias("shape"), i.alias("pos"), F.lit(length).alias("length"),
            F.when(F.col("slots").isNotNull() & F.exists(part(i), lambda x: x.isNotNull()), part(i)).alias("slots")))

    found = _templates(texts, keys, min(lengths), inside).select(*keys, F.inline(F.concat(*[of(n) for n in lengths])))
    few = F.col("slots").isNotNull() & (F.size(F.filter("slots", lambda x: x.isNotNull())) > F.col("length") - MIN_LITERALS)
    return found.withColumn("key", F.when(few, F.xxhash64("shape", F.array_join("slots", " "))).otherwise(F.col("shape")))


def _same_shapes(texts: DataFrame, shapes: DataFrame, lengths: list[int]) -> DataFrame:
    """(id), each once: the documents (id, text) with a window of a shape (shape). Windows are hashes here, without their slots."""
    found = _templates(texts, ["id"], min(lengths), False).select(
        "id", F.explode(F.concat(*[_shapes(n) for n in lengths])).alias("shape"))
    return found.join(broadcast_up_to(shapes, MOST_WINDOWS), "shape", "left_semi").select("id").distinct()


def _shapes(length: int) -> Column:
    return F.transform(_starts(length, False), lambda i: _shape(i, length))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, item_words, n_windows, n_found, reparameterised): one row per document and item it leaks.

    n_windows counts the item's windows, n_found those found in the document; reparameterised tells
    whether a slot differs. Whole texts are looked at. Items of fewer than eight words are one window;
    item_words, the words of the item, tells such finds apart. Texts without words match nothing; empty
    tables give no rows. Rows that repeat an item count once, rows that share a document id are one document, and
    a null id is an id like any other. Other columns are not looked at.

    All windows of all documents are compared by their shape first; slots are cut only in documents that share one.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    # Items also as documents write them whose sentences go on from others, in lower case and with a capital on every word.
    forms = [(items, False), (items, True), *((items.withColumn("text", f("text")), False) for f in (F.lower, F.initcap))]
    items = reduce(DataFrame.union, [windows(x, ["item_id", "item"], range(1, WINDOW + 1), True, inside) for x, inside in forms]).distinct()
    items = stage(items.withColumnsRenamed({"pos": "item_pos", "slots": "item_slots"}), "benchmark")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect()) or [WINDOW]  # eight at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    near = stage(_same_shapes(texts, items.select("shape").distinct(), lengths).withColumnRenamed("id", "near"), "near")
    texts = texts.join(broadcast_up_to(near, MOST_LEAKS), F.col("id").eqNullSafe(F.col("near")), "left_semi")
    found = windows(texts, ["id"], lengths).drop("length", "shape").join(broadcast_up_to(items.drop("length", "shape"), MOST_WINDOWS), "key")
    pair = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(F.coalesce(pair, F.array().cast("array<struct<a:string,b:string>>")), lambda p: p["a"].isNotNull())
    # One alignment has at most as many windows as the item.
    lines = found.groupBy("id", "item_id", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set(F.struct("item_pos", pairs.alias("pairs"))).alias("seen")).withColumn("pairs", F.array_distinct(F.flatten("seen.pairs")))
    differs = lambda p: ~p["a"].eqNullSafe(p["b"])
    # A value of the item that becomes several, or several that become one, tell of another text.
    torn = lambda p: F.exists("pairs", lambda q: (q["a"] == p["a"]) != q["b"].eqNullSafe(p["b"]))
    counted = F.filter("seen", lambda w: ~F.exists(w["pairs"], lambda p: differs(p) & torn(p)))
    covered = lines.select("id", "item_id", "item", F.explode(counted).alias("w")).select(
        "id", "item_id", "item", F.exists("w.pairs", differs).alias("changed"), F.col("w.item_pos").alias("at"))
    covered = covered.groupBy("id", "item_id", "item").agg(F.countDistinct("at").alias("n_found"), F.max("changed").alias("reparameterised"))
    sizes = items.groupBy("item_id", "item").agg(F.countDistinct("item_pos").alias("n_windows"), (F.max("item_pos") + F.max("length")).cast("int").alias("item_words"))
    leaked = covered.withColumn("own", F.col("item")).drop("item").join(
        broadcast_up_to(sizes.select("n_windows", "item_words", F.col("item").alias("own")), MOST_WINDOWS), "own")
    return leaked.where(F.col("n_found") >= MIN_SHARE * F.col("n_windows")).select("id", "item_id", "item_words", "n_windows", "n_found", "reparameterised")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of ``docs`` that leak no item of at least so many words; rows without id stay.

    Shorter items ("Yes") stand in many documents that are no copies of a benchmark; ``leaks`` reports them.
    """
    found = leaks(docs, benchmark, id_col, text_col).where(F.col("item_words") >= least_words)
    gone = stage(found.select(F.col("id").alias("_gone")).distinct(), "leaking")
    # The row itself in one column, so that no name of it can clash.
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"))
    return rows.join(broadcast_up_to(gone, MOST_LEAKS), F.col("_id") == F.col("_gone"), "left_anti").select("_doc.*")
