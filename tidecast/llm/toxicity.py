"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Beside a fixed list of insults there is a learned one: words and beginnings of words that far more
toxic than other training texts have, whatever their language. A training row's densities are those
of a list learned from the other training folds, so that trees do not trust what a list knows by heart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.boosted import Boosted, calibrated, fit_boosted, fit_isotonic
from tidecast.llm.common import broadcast_up_to
from tidecast.staging import stage

# Insults and threats in the languages of the corpus, and how one is addressed in them.
INSULTS = (
    "arsch arschloch asshole bastard basura bitch bullshit cabron clown clowns cochon connard coward cretin crétin degenerate disgusting dumb dumbass dummkopf estúpido filth fool "
    "fools freak fuck fucking garbage gilipollas idiot idiota idiote idiots imbecile imbécil imbécile loser losers lunatic maggot mierda moron morons parasite pathetic payaso "
    "shit pig pigs puta putain retard rubbish salaud salope scheiße schlampe scum scumbag shit sick slut stupid stupide trash trottel ugly useless vermin whore worthless").split()
THREATS = "burn hang hate hunt hurt kill murder rape shoot stab strangle suffer".split()
SECOND = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre usted ustedes tú".split()
# Letters that digits and signs stand in for; the marks after them are dropped.
STAND_INS, LETTERS = "013457@$!.-_*", "oieastasi"

# Labelled ids that may be broadcast to the texts; more of them are joined by a shuffle.
MOST_LABELS = 1_000_000

# Letters of the beginnings that are learned; a shorter word is also learned as a whole, with the mark before it.
BEGINNINGS = (3, 4, 5, 6)
WHOLE = "="
# Least log odds of the three grades of learned pieces, how many standard errors they are above 0, the toxic texts that
# must have them, and the most pieces of a list.
GRADES = (1.5, 2.5, 4.0)
LEAST_ERRORS = 4.0
LEAST_DOCS = 5
MOST_PIECES = 4_000
TRAINING_FOLDS = (2, 3, 4)

LEARNED = ("slight_log", "fair", "fair_log", "strong", "strong_log")
FEATURES = ("insults", "insults_log", "hidden_insults", "hidden_log", "threats", "second", "aimed", "capitals", "shouted", "marks", "marks_run", "masked", *LEARNED)


_STANDS_IN = r"[0-9@$*_]\p{L}|\p{L}[0-9@$*_]|\p{L}[.!\-]\p{L}"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _listed(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(lexicon))).cast("double")


def _words(text: Column) -> Column:
    return F.split(text, r"[^\p{L}\p{N}]+")


def pieces(words: Column) -> Column:
    """The distinct beginnings of all words, and whole words that are no longer than those."""
    starts = [_beginnings(words, k) for k in BEGINNINGS]
    short = F.filter(words, lambda w: F.char_length(w).between(BEGINNINGS[0], BEGINNINGS[-1]))
    return F.array_distinct(F.concat(*starts, F.transform(short, lambda w: F.concat(F.lit(WHOLE), w))))


def _beginnings(words: Column, letters: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.char_length(w) >= letters), lambda w: F.substring(w, 1, letters))


@dataclass(frozen=True)
class Lexicon:
    """Learned pieces with their log odds."""

    odds: dict[str, float]

    def at_least(self, grade: float) -> list[str]:
        return sorted(p for p, x in self.odds.items() if x >= grade)


def _any_piece(word: Column, listed: list[str]) -> Column:
    found = F.concat(F.lit(WHOLE), word).isin([p for p in listed if p[:1] == WHOLE])
    for k in BEGINNINGS:
        found = found | F.substring(word, 1, k).isin([p for p in listed if p[:1] != WHOLE and len(p) == k])
    return found


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, class, n_2 … n_4): how often a word occurs in each training fold, by class. ``texts`` has text, fold and toxic."""
    words = texts.select("fold", F.col("toxic").alias("class"), F.explode(_words(F.lower("text"))).alias("word"))
    return words.groupBy("word", "class").agg(*[F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in TRAINING_FOLDS])


def piece_counts(counted: DataFrame) -> DataFrame:
    """(piece, n_2_0, n_2_1, …): how many words with a piece each training fold and class has, from word_counts."""
    cut = counted.select("*", F.explode(pieces(F.array("word"))).alias("piece"))
    return cut.groupBy("piece").agg(*[
        F.coalesce(F.sum(F.when(F.col("class") == c, F.col(f"n_{f}"))), F.lit(0)).alias(f"n_{f}_{c}") for f in TRAINING_FOLDS for c in (0, 1)])


def texts_with_pieces(texts: DataFrame, listed: list[str]) -> DataFrame:
    """(piece, docs_2 … docs_4): how many toxic texts of each training fold have a word with a listed piece."""
    hits = F.filter(F.array_distinct(_words(F.lower("text"))), lambda w: _may_have(w, listed))
    held = texts.where("toxic = 1").select("fold", F.explode(pieces(hits)).alias("piece")).where(F.col("piece").isin(listed))
    return held.groupBy("piece").agg(*[F.count_if(F.col("fold") == f).alias(f"docs_{f}") for f in TRAINING_FOLDS])


def learn_lexicons(texts: DataFrame) -> dict[int | None, Lexicon]:
    """The lexicon of all training folds (key None), and for each fold that of the others, from ``texts`` (text, fold, toxic).

    Log odds are those of the shares of words with a piece among all words of toxic and of other
    texts, each count raised by one. Pieces below the least grade, or by fewer than LEAST_ERRORS
    standard errors above 0 are left out; of more than MOST_PIECES those by most standard errors
    stay, of equal ones the first. Of these, pieces in fewer than LEAST_DOCS toxic texts are left out.
    """
    texts = texts.where(F.col("fold").isin(*TRAINING_FOLDS))
    counted = stage(word_counts(texts), "words")
    by_fold = [F.sum(f"n_{f}").alias(f"n_{f}") for f in TRAINING_FOLDS]
    sizes = {r["class"]: r for r in counted.groupBy("class").agg(*by_fold).collect()}  # two rows
    counts = stage(piece_counts(counted), "pieces")
    found = {}
    for left_out in (None, *TRAINING_FOLDS):
        folds = [f for f in TRAINING_FOLDS if f != left_out]
        n0, n1 = (sum(sizes[c][f"n_{f}"] for f in folds) if c in sizes else 0 for c in (0, 1))
        c0, c1 = (sum((F.col(f"n_{f}_{c}") for f in folds), F.lit(0)) for c in (0, 1))
        odds = F.log((c1 + 1) / (n1 + 2)) - F.log((c0 + 1) / (n0 + 2))
        judged = counts.select("piece", F.round(odds, 9).alias("odds"), F.round(odds / F.sqrt(1 / (c1 + 1) + 1 / (c0 + 1)), 9).alias("errors"))
        kept = judged.where((F.col("odds") >= GRADES[0]) & (F.col("errors") >= LEAST_ERRORS)).orderBy(F.desc("errors"), "piece").limit(MOST_PIECES)
        found[left_out] = {r["piece"]: r["odds"] for r in kept.collect()}
    every = sorted(set().union(*found.values()))
    docs = {r["piece"]: r for r in texts_with_pieces(texts, every).collect()} if every else {}  # a row for each listed piece at most
    enough = lambda p, left_out: p in docs and sum(docs[p][f"docs_{f}"] for f in TRAINING_FOLDS if f != left_out) >= LEAST_DOCS
    return {left_out: Lexicon({p: x for p, x in odds.items() if enough(p, left_out)}) for left_out, odds in found.items()}


def _may_have(word: Column, listed: list[str]) -> Column:
    """Whether a word begins as some listed piece does: one look-up that most words fail."""
    return F.substring(word, 1, BEGINNINGS[0]).isin(sorted({p.removeprefix(WHOLE)[:BEGINNINGS[0]] for p in listed}))


def with_features(texts: DataFrame, text_col: str, lexicons: dict[int | None, Lexicon] | None = None, fold_col: str | None = None) -> DataFrame:
    """Adds FEATURES of the whole text, rates by word or character; all zero for a null or empty text.

    Words are looked up in all lists at once; what only few texts can have (words behind stand-ins,
    insults near the second person) is looked for in those only. Rows of a training fold named by
    ``fold_col`` are compared with the lexicon of the other folds, all others with that of all folds.
    """
    lexicons = lexicons or {None: Lexicon({})}
    low = F.lower("_text")
    one = texts.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_words", _words(low))
    one = one.withColumn("_hits", F.filter("_words", lambda w: w.isin([*INSULTS, *THREATS, *SECOND]))).withColumns({
        "_n": F.greatest(F.lit(1), F.size("_words")).cast("double"), "_chars": F.greatest(F.lit(1), F.char_length("_text")).cast("double"),
        "_insults": _listed(F.col("_hits"), INSULTS), "_second": _listed(F.col("_hits"), SECOND)})
    hidden = F.when(F.col("_text").rlike(_STANDS_IN), _listed(_words(F.translate(low, STAND_INS, LETTERS)), INSULTS)).otherwise(F.col("_insults"))
    # An insult at most three words before or after the second person.
    spots = F.filter(F.transform("_words", lambda w, k: F.struct(w.isin(SECOND).alias("second"), w.isin(INSULTS).alias("insult"), k.alias("k"))), lambda s: s["second"] | s["insult"])
    aimed = F.size(F.filter(spots, lambda s: s["insult"] & F.exists(spots, lambda o: o["second"] & (F.abs(o["k"] - s["k"]) <= 4)))).cast("double")
    n, chars, text = F.col("_n"), F.col("_chars"), F.col("_text")
    grades = _by_fold(lambda lexicon: _grades(F.col("_words"), lexicon), lexicons, fold_col)
    one = one.withColumn("_hidden", F.greatest(hidden, F.col("_insults"))).withColumn("_grades", grades)
    slight, fair, strong = (F.size(F.filter("_grades", lambda g: g >= k)).cast("double") for k in (1, 2, 3))
    return one.withColumns({
        "insults": F.col("_insults") / n, "insults_log": F.log1p("_insults"),
        "hidden_insults": (F.col("_hidden") - F.col("_insults")) / n, "hidden_log": F.log1p("_hidden"),
        "threats": _listed(F.col("_hits"), THREATS) / n, "second": F.col("_second") / n,
        "aimed": F.when((F.col("_insults") > 0) & (F.col("_second") > 0), aimed).otherwise(0.0) / n,
        "capitals": _count(text, r"\p{Lu}") / chars, "shouted": _count(text, r"\p{Lu}\p{Lu}+(?!\p{L})") / n,
        "marks": _count(text, "[!?]") / chars, "marks_run": _count(text, "[!?][!?]+|[*#%$&]{3,}") / n,
        "masked": F.when(text.rlike(_STANDS_IN), _count(text, r"\p{L}[0-9@$*!]+\p{L}")).otherwise(0.0) / n,
        "slight_log": F.log1p(slight), "fair": fair / n, "fair_log": F.log1p(fair), "strong": strong / n, "strong_log": F.log1p(strong),
    })


def _by_fold(value: Callable[[Lexicon], Column], lexicons: dict[int | None, Lexicon], fold_col: str | None) -> Column:
    out = value(lexicons[None])
    for f in TRAINING_FOLDS if fold_col else ():
        out = F.when(F.col(fold_col) == f, value(lexicons[f])).otherwise(out)
    return out


def _grades(words: Column, lexicon: Lexicon) -> Column:
    """1, 2 or 3 for each word with a learned piece: the highest grade of its pieces."""
    listed = [lexicon.at_least(g) for g in GRADES]
    hits = F.filter(words, lambda w: _may_have(w, listed[0]) & _any_piece(w, listed[0]))
    return F.transform(hits, lambda w: F.when(_any_piece(w, listed[2]), 3).when(_any_piece(w, listed[1]), 2).otherwise(1))


def _with_features(docs: DataFrame, text_col: str, lexicons: dict[int | None, Lexicon], fold_col: Column | None = None) -> DataFrame:
    """(_doc, FEATURES): the row itself in one column, so that no name of it can clash."""
    rows = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_raw_text"), (F.lit(None).cast("int") if fold_col is None else fold_col).alias("_fold"))
    return with_features(rows, "_raw_text", lexicons, None if fold_col is None else "_fold").select("_doc", *FEATURES)


def fold(id_col: str) -> Column:
    """0: held out, 1: calibration, 2 to 4: trees. Rows without id belong to the last, if labelled at all."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(4)), F.lit(5))


class Scorer:
    """The learned lexicons, trees and the curve that calibrates them."""

    def __init__(self, lexicons: dict[int | None, Lexicon], trees: Boosted, corners: list[tuple[float, float]]):
        self.lexicons, self.trees, self.corners = lexicons, trees, corners

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(_doc, score, predicted): every row of ``docs`` with its score, in one pass without a shuffle."""
        scored = self.trees.score(_with_features(docs, text_col, self.lexicons), "_raw").withColumn("score", calibrated(F.col("_raw"), self.corners))
        return scored.select("_doc", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Lexicon and trees from folds 2 to 4 of the labelled rows, the calibration curve from fold 1; fold 0 is never read.

    Labels other than 0 and 1, null ones and ids without text are passed over; of repeated labels
    of an id the largest counts. With one class or no labels the score is that class, or 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(broadcast_up_to(known, MOST_LABELS), "_id")
    lexicons = learn_lexicons(texts.select(F.coalesce("_text", F.lit("")).alias("text"), fold("_id").cast("int").alias("fold"), F.col("_toxic").alias("toxic")))
    rows = _with_features(texts, "_text", lexicons, fold("_id").cast("int")).select(F.col("_doc._toxic").alias("toxic"), fold("_doc._id").alias("_fold"), *FEATURES)
    rows = stage(rows, "labelled")
    trees = fit_boosted(rows.where("_fold > 1"), FEATURES, "toxic")
    return Scorer(lexicons, trees, fit_isotonic(trees.score(rows.where("_fold = 1"), "_raw"), "_raw", "toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, score, predicted): one row per row of ``docs``; the score of a text depends on its characters alone.

    Null and empty texts are scored as texts without any mark. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = learn(docs, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), "id", "text", "label").score(docs)
    return scored.select("_doc.id", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    return learn(docs, labels, id_col, text_col, label_col).score(docs, text_col).where("predicted = 0").select("_doc.*")
