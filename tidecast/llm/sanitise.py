"""Personal data by information-theoretic sanitisation, with Spark functions only.

Entities that patterns tell (addresses, numbers) are protected. How strongly a term reveals one is
estimated on the corpus: with probabilities as shares of distinct texts, a term t that stands beside
entity e discloses the part PMI(t; e) / IC(e) of the information of e, where IC(e) = -log p(e) and
PMI(t; e) = log p(t, e) / (p(t) p(e)); it is 1 for a term that never occurs without e. Terms that
disclose GENERALISE or more are generalised to the kind of the entity, those at REMOVE or more are
removed, wherever they stand. Terms are judged only where MIN_TEXTS different texts have them beside e.

Spans are found by splitting a text at a pattern: pieces and matches in turn make up the text, so a
match begins at the sum of the lengths before it. Spans depend on the text alone, so each text has
its own once, by its digest. Patterns are possessive and look behind, so that no run of characters is
read more than once from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import broadcast_up_to
from tidecast.staging import stage

# Kinds in the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must have for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"\p{L}+"
LEAST_LETTERS = 3
# Code points of the text on each side of an entity whose words are its context.
CONTEXT = 64
MIN_TEXTS = 3
GENERALISE, REMOVE = 0.95, 0.99
# Terms, and texts that hold some, that may be broadcast; more of them are joined by a shuffle.
MOST_TERMS = 200_000
MOST_TEXTS = 200_000
# Sizes summed in one go.
_CHUNK = 64


@dataclass(frozen=True)
class Limits:
    """When a term counts as disclosing."""

    context: int = CONTEXT
    min_texts: int = MIN_TEXTS
    generalise: float = GENERALISE
    remove: float = REMOVE


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is evaluated once a row however often it is used, also at each place of a lambda function."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _before(df: DataFrame, values: str, out: str, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds the array of what ``join`` makes of 0 and all numbers before each place of the array ``values``.

    Chunks are joined first, then what lies before each chunk: no place reads the whole array.
    """
    def whole(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), join)

    count = F.floor((F.size(values) + _CHUNK - 1) / _CHUNK).cast("int")
    df = _once(df, "_chunks", F.transform(F.sequence(F.lit(0), count), lambda c: whole(F.slice(values, c * _CHUNK + 1, _CHUNK))))
    df = _once(df, "_heads", F.transform("_chunks", lambda x, c: whole(F.slice("_chunks", F.lit(1), c))))
    at = F.transform(values, lambda x, i: join(
        F.get("_heads", F.floor(i / _CHUNK).cast("int")), whole(F.slice(values, (i - i % _CHUNK + 1).cast("int"), i % _CHUNK))))
    return _once(df, out, at).drop("_chunks", "_heads")


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    if kind == "card":
        # Luhn: from the right, every second digit counts double, less nine where that has two digits.
        figures = F.reverse(F.split(digits, ""))
        even = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
        luhn = F.aggregate(even, F.lit(0), lambda a, x: a + x) % 10 == 0
        return F.when(F.char_length(digits).between(14, 19), luhn).otherwise(False)
    return F.lit(True)


def matches(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """A row for each match of ``pattern`` in the column ``text``: the other columns, start, end, value, and the text before and after it.

    Spans are in code points, the end exclusive; before and after reach to the neighbouring matches.
    """
    others = [c for c in df.columns if c != text]
    df = _once(df, "_values", F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).where(F.size("_values") > 0)
    df = _once(df, "_pieces", F.split(text, pattern, -1)).drop(text)
    df = _once(df, "_sizes", F.zip_with(F.slice("_pieces", F.lit(1), F.size("_values")), "_values", lambda p, v: (F.char_length(p) + F.char_length(v)).cast("long")))
    df = _before(df, "_sizes", "_starts", lambda a, x: a + x)

    def found(v: Column, i: Column) -> Column:
        before = F.get("_pieces", i)
        start = F.get("_starts", i) + F.char_length(before)
        return F.struct(start.alias("start"), (start + F.char_length(v)).alias("end"), v.alias("value"), before.alias("before"), F.get("_pieces", i + 1).alias("after"))
    return df.select(*others, F.inline(F.transform("_values", found)))


def entity_spans(texts: DataFrame, context: int) -> DataFrame:
    """(text_key, start, place, kind, end, value, left, right): the entities of ``texts`` (text_key, text).

    place is that of the kind in KINDS; left and right are the ``context`` code points beside the
    entity, up to the next match of its pattern, without words that their ends or the entity cut.
    """
    def of(place: int, kind: str) -> DataFrame:
        tried = F.contains("text", F.lit("@")) if kind == "email" else F.col("text").rlike(HINTS[kind])
        found = matches(texts.where(tried), "text", PATTERNS[kind]).where(_valid(kind, F.col("value")))
        left, right = F.right("before", F.lit(context)), F.left("after", F.lit(context))
        left = F.when(F.char_length("before") > context, F.regexp_replace(left, rf"^{WORD}", "")).otherwise(left)
        right = F.when(F.char_length("after") > context, F.regexp_replace(right, rf"{WORD}$", "")).otherwise(right)
        left = F.when(F.col("value").rlike(r"^\p{L}"), F.regexp_replace(left, rf"{WORD}$", "")).otherwise(left)
        right = F.when(F.col("value").rlike(r"\p{L}$"), F.regexp_replace(right, rf"^{WORD}", "")).otherwise(right)
        return found.select("text_key", "start", F.lit(place).alias("place"), F.lit(kind).alias("kind"), "end", "value", left.alias("left"), right.alias("right"))
    return reduce(DataFrame.union, [of(k, kind) for k, kind in enumerate(KINDS)])


def _text_key(text: str) -> Column:
    return F.md5(F.col(text).cast("binary"))


def terms(text: Column) -> Column:
    """The distinct words of a text that can be terms, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.char_length(w) >= LEAST_LETTERS))


def _entity(kind: Column, value: Column) -> Column:
    """One form for all ways to write an entity: addresses in lower case, numbers by their digits."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value)))


def disclosures(texts: DataFrame, spans: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """((term, kind, disclosed), (text_key, term)): the disclosing terms of ``texts`` (text_key, text), and the texts that hold them.

    ``spans`` are those of entity_spans, of which each text has its own once. Texts are counted once
    however often they occur. An entity in every text has no information and is revealed by nothing.
    Ties between kinds go to the first in KINDS.
    """
    beside = spans.select("text_key", "kind", _entity(F.col("kind"), F.col("value")).alias("entity"), F.concat_ws("\n", "left", "right").alias("near"))
    n_texts = texts.where("text <> ''").select("text_key").distinct().count()
    information = F.nullif(F.log2(F.lit(float(n_texts)) / F.col("n_entity")), F.lit(0.0))
    disclosed = lambda of: F.round(1 + F.log2(F.col("n_both") / F.col(of)) / information, 9)
    entities = beside.select("text_key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    near = stage(beside.select("text_key", "kind", "entity", F.explode(terms(F.col("near"))).alias("term")).distinct(), "near")
    pairs = near.groupBy("kind", "entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= limits.min_texts)
    # Texts that have the term beside any entity are some of those that have it: words that are common there need no count in all texts.
    beside_any = near.select("term", "text_key").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = pairs.join(entities, "entity").join(beside_any, "term").where(disclosed("n_near") >= limits.generalise)
    pairs = stage(pairs, "pairs")
    held = texts.select("text_key", F.explode(terms(F.col("text"))).alias("term"))
    held = stage(held.join(broadcast_up_to(pairs.select("term").distinct(), MOST_TERMS), "term").distinct(), "held")
    counts = held.groupBy("term").agg(F.count("*").alias("n_term"))
    judged = pairs.join(counts, "term").withColumn("disclosed", disclosed("n_term")).where(F.col("disclosed") >= limits.generalise)
    place = reduce(lambda out, k: F.when(F.col("kind") == KINDS[k], k).otherwise(out), range(len(KINDS)), F.lit(len(KINDS)))
    found = judged.groupBy("term").agg(F.min(F.struct((-F.col("disclosed")).alias("minus"), place.alias("place"), "kind")).alias("best"))
    found = stage(found.select("term", "best.kind", (-F.col("best.minus")).alias("disclosed")), "disclosing")
    return found, held.join(broadcast_up_to(found.select("term"), MOST_TERMS), "term", "left_semi").select("text_key", "term")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(id, spans, sanitised): per row of ``docs`` its spans (start, place, kind, end, action) in order, and the text without them.

    Spans of entities are found in every text, those of disclosing terms beside them unless they overlap
    one. In sanitised an entity is [kind], a generalised term [kind-term] and a removed one is gone; of
    overlapping spans the first stands for all. A null text counts as an empty one, which has no spans; rows
    that repeat are rows of their own and texts that repeat are counted once; an empty table gives no rows. Other columns are not
    looked at. Results do not depend on the order of the rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", _text_key("text"))
    texts = docs.select("text_key", "text")
    base = stage(entity_spans(texts, limits.context).distinct(), "entities")
    found, held = disclosures(texts, base, limits)
    marked = stage(held.join(broadcast_up_to(found, MOST_TERMS), "term"), "marked")
    holders = broadcast_up_to(marked.select("text_key").distinct(), MOST_TEXTS)
    words = matches(texts.join(holders, "text_key", "left_semi").dropDuplicates(["text_key"]), "text", WORD).withColumn("term", F.lower("value"))
    words = words.join(marked, ["text_key", "term"])
    action = F.when(F.col("disclosed") >= limits.remove, "remove").otherwise("generalise")
    told = words.select("text_key", "start", F.lit(len(KINDS)).alias("place"), F.lit(TERM).alias("kind"), "end", action.alias("action"), F.col("kind").alias("of"))
    sure = base.select("text_key", "start", "place", "kind", "end", F.lit("replace").alias("action"), F.col("kind").alias("of"))
    spans = sure.union(told).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end", "action", "of"))).alias("_all"))
    taken = F.filter("_all", lambda s: s["kind"] != TERM)
    overlaps = lambda s: F.exists("_taken", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = _once(spans, "_taken", taken).select("text_key", F.filter("_all", lambda s: (s["kind"] != TERM) | ~overlaps(s)).alias("_spans"))
    rows = docs.join(broadcast_up_to(stage(spans, "spans"), MOST_TEXTS), "text_key", "left").drop("text_key")
    none = F.array().cast(spans.schema["_spans"].dataType)
    rows = _once(rows, "spans", F.coalesce("_spans", none)).drop("_spans")
    rows = _before(_once(rows, "_ends", F.transform("spans", lambda s: s["end"])), "_ends", "_done", lambda a, x: F.greatest(a, x))
    mark = lambda s: F.when(s["action"] == "replace", F.concat(F.lit("["), s["of"], F.lit("]"))).when(
        s["action"] == "generalise", F.concat(F.lit("["), s["of"], F.lit("-term]"))).otherwise("")

    def kept(s: Column, i: Column) -> Column:
        done = F.get("_done", i)
        return F.when(s["start"] >= done, F.concat(F.substring("text", (done + 1).cast("int"), (s["start"] - done).cast("int")), mark(s))).otherwise("")
    rest = F.substring("text", (F.array_max("_ends") + 1).cast("int"), F.char_length("text"))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", kept), ""), rest)).otherwise(F.col("text"))
    return rows.select("id", "spans", text.alias("sanitised"))
