"""One named query per operator, with production parameters, and DuckDB SQL where it can state the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import bpe, chat, decontaminate, hpylm, html_crf, mixing, pq_dedup, sanitise, simhash, toxicity, url_filter, variants, vector_codes


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = chat.format_chats(rows.unionByName(extra))
    chats = chats.withColumn("back", chat.read_chats(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.col("conv").alias("conv_id"), F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = r"""regexp_replace({}, '([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g')"""
OP2_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS role_before FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(length({_ESCAPED.format('text')}) + CASE WHEN role_before = role THEN 8
    ELSE 24 + length({_ESCAPED.format('role')}) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pq_dedup.embedding_components(_table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


OP3_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.root AS component_id, e.vec_id = c.root AS kept
FROM embeddings e JOIN (SELECT node, min(root) AS root FROM reached GROUP BY node) c ON c.node = e.vec_id
"""


def _held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 7 == 2


def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = hpylm.score_texts(_table(spark, folder, "documents"), _held_out).withColumnRenamed("id", "doc_id")
    return scored.withColumn("held_out", _held_out(F.col("doc_id")))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return scored.select(F.col("id").alias("doc_id"), (toxicity.fold("id") == 0).alias("held_out"), "score", "predicted")


RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"), RULES).withColumnRenamed("id", "page_id")


def op7_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


# Target weights of the mix; sources share evenly. Half of all tokens are asked for.
MIX_WEIGHTS = {"domain": {"short": 15, "article": 60, "long": 25}, "lang": {"en": 50, "fr": 20, "de": 20, "es": 10}}


def mix_levels() -> dict:
    size = F.coalesce(F.char_length("text"), F.lit(0))
    domain = F.when(size < 1_000, "short").when(size < 10_000, "article").otherwise("long")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), mix_levels(), MIX_WEIGHTS)


def _sql_fill(name: str, parents: str, budget: str, weight: str) -> str:
    """One level of the tree: what fills up gets its room, the rest by cumulated weight."""
    keys = ["domain", "lang", "source"][: parents.count(",") + 1 if parents else 1]
    child = keys[-1] if not parents else ["domain", "lang", "source"][parents.count(",") + 1]
    cols = f"{parents}, {child}" if parents else child
    part = f"PARTITION BY {parents}" if parents else ""
    join = f"JOIN {budget} b USING ({parents})" if parents else f"CROSS JOIN {budget} b"
    return f"""
{name}_in AS (
  SELECT {cols}, room, budget, CAST({weight} AS HUGEINT) AS w
  FROM (SELECT {cols}, CAST(sum(size) * 4 AS HUGEINT) AS room FROM leaves WHERE size > 0 GROUP BY {cols}) {join}
), {name}_full AS (
  SELECT *, room * CAST(sum(w) OVER (ROWS_AFTER) AS HUGEINT) <= (budget - coalesce(CAST(sum(room) OVER (ROWS_BEFORE) AS HUGEINT), 0)) * w AS filled
  FROM {name}_in
), {name}_open AS (
  SELECT *, budget - coalesce(CAST(sum(room) FILTER (filled) OVER ({part}) AS HUGEINT), 0) AS rest,
    CAST(sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}) AS HUGEINT) AS w_open,
    CAST(sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part} ORDER BY {child}) AS HUGEINT) AS w_upto
  FROM {name}_full
), {name} AS (
  SELECT {cols}, CAST(CASE WHEN filled THEN room ELSE (rest * w_upto) // w_open - (rest * (w_upto - w)) // w_open END AS HUGEINT) AS budget FROM {name}_open
)""".replace("ROWS_AFTER", f"{part} ORDER BY CAST(room AS DOUBLE) / CAST(w AS DOUBLE), {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING").replace(
        "ROWS_BEFORE", f"{part} ORDER BY CAST(room AS DOUBLE) / CAST(w AS DOUBLE), {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")


def mix_sql(documents: str = "documents") -> str:
    """The mix over a table expression with the columns of documents."""
    return rf"""
WITH sizes AS (
  SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 1000 THEN 'short' WHEN length(text) < 10000 THEN 'article' ELSE 'long' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens,
    coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key
  FROM {documents}
), leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS size FROM sizes GROUP BY ALL),
total AS (SELECT CAST(coalesce(sum(size), 0) AS HUGEINT) // 2 AS budget FROM leaves),
{_sql_fill('d', '', 'total', "CASE domain WHEN 'short' THEN 15 WHEN 'article' THEN 60 WHEN 'long' THEN 25 ELSE 1 END")},
{_sql_fill('l', 'domain', 'd', "CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 20 WHEN 'de' THEN 20 WHEN 'es' THEN 10 ELSE 1 END")},
{_sql_fill('s', 'domain, lang', 'l', "1")},
placed AS (
  SELECT sizes.*, CAST(budget // size AS BIGINT) AS full_epochs, CAST(budget % size AS BIGINT) AS rest
  FROM sizes JOIN leaves USING (domain, lang, source) JOIN s USING (domain, lang, source) WHERE n_tokens > 0
), taken AS (
  SELECT *, greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('17:' || full_epochs || ':' || key), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS prefix_tokens
  FROM placed
)
SELECT doc_id, domain, lang, source, n_tokens, full_epochs, CAST(prefix_tokens AS BIGINT) AS prefix_tokens,
  CAST(full_epochs * n_tokens + prefix_tokens AS BIGINT) AS taken_tokens
FROM taken WHERE full_epochs * n_tokens + prefix_tokens > 0
"""


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                          bpe.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    found = html_crf.main_text(pages, html_crf.train_on(pages))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, _ = vector_codes.compress(_table(spark, folder, "embeddings"))
    return coded.withColumnRenamed("id", "vec_id")


def _lloyd_round(k: int) -> str:
    """Parts with their nearest entry under the codebooks before round k, and the codebooks after it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT row, pos, p, arg_min(entry, (gap, entry)) AS entry, CAST(min(gap) AS BIGINT) AS gap FROM (
    SELECT x.row, x.pos, x.p, b.entry, x.norm - 2 * list_dot_product(x.p, b.p) + b.norm AS gap FROM parts x JOIN b{k} b ON b.pos = x.pos
  ) GROUP BY row, pos, p
), m{k} AS (
  SELECT pos, entry, list(CAST(v AS DOUBLE) ORDER BY j) AS p FROM (
    SELECT pos, entry, j, CAST(sum(CAST(p[j] AS BIGINT)) AS BIGINT) AS total, count(*) AS n,
      (total - ((total % n) + n) % n) // n AS v
    FROM a{k}, (SELECT unnest(generate_series(1, (SELECT width FROM size))) AS j) GROUP BY pos, entry, j
  ) GROUP BY pos, entry
), b{k + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(m.p, b.p) AS p, list_dot_product(coalesce(m.p, b.p), coalesce(m.p, b.p)) AS norm
  FROM b{k} b LEFT JOIN m{k} m ON m.pos = b.pos AND m.entry = b.entry
)"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE) FOR x IN embedding] AS q, row_number() OVER (ORDER BY vec_id, embedding) AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), size AS (SELECT max(len(q)) // 4 AS width FROM kept),
parts AS MATERIALIZED (
  SELECT row, pos, q[pos * width + 1:(pos + 1) * width] AS p, list_dot_product(p, p) AS norm FROM kept, size, (SELECT unnest([0, 1, 2, 3]) AS pos)
), b0 AS MATERIALIZED (SELECT pos, row - 1 AS entry, p, norm FROM parts WHERE row <= 256),{",".join(_lloyd_round(k) for k in range(5))},
coded AS (
  SELECT row, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY pos) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a4 GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(p[j] AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, j))
   FROM b4, (SELECT unnest(generate_series(1, (SELECT width FROM size))) AS j)) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


def _count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op12_pii_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    found = sanitise.sanitise(_table(spark, folder, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != sanitise.TERM)
    return found.select(F.col("id").alias("doc_id"), *map(_count_kind, sanitise.KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


_OP12_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _sql_matches(source: str, place: int, kind: str, pattern: str) -> str:
    """Matches with the texts before and after them; a match begins where all pieces and matches before it end."""
    return rf"""
  SELECT key, {place} AS place, '{kind}' AS kind, v, before, after,
    CAST(sum(length(before) + length(v)) OVER (PARTITION BY key ORDER BY i) AS BIGINT) - length(v) AS start FROM (
    SELECT key, i, v[i] AS v, p[i] AS before, p[i + 1] AS after FROM (
      SELECT key, v, p, unnest(range(1, len(v) + 1)) AS i FROM (
        SELECT key, regexp_extract_all(text, '{pattern}') AS v, string_split_regex(text, '{pattern}') AS p FROM {source})))"""


OP12_SQL = rf"""
WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key FROM documents),
texts AS MATERIALIZED (SELECT key, first(text) AS text FROM docs GROUP BY key),
found AS MATERIALIZED ({" UNION ALL ".join(_sql_matches("texts", k, kind, pattern) for k, (kind, pattern) in enumerate(_OP12_PATTERNS.items()))}
), figures AS (
  SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, list_transform(string_split(v, '.'), lambda x: try_cast(x AS HUGEINT)) AS bytes FROM found
), base AS MATERIALIZED (
  SELECT key, place, kind, v, before, after, start, start + length(v) AS stop,
    kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE lower(v) END AS entity
  FROM figures WHERE kind = 'email' OR kind = 'ip' AND len([x FOR x IN bytes IF x IS NOT NULL AND x <= 255]) = 4
    OR kind = 'phone' AND length(digits) BETWEEN 10 AND 15
    OR kind = 'card' AND length(digits) BETWEEN 14 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INTEGER)
      ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(reverse(digits)[i] AS INTEGER) + 1] END FOR i IN range(1, length(digits) + 1)]) % 10 = 0
), beside AS (
  SELECT key, kind, entity, CASE WHEN regexp_matches(v, '^\p{{L}}') THEN regexp_replace(l, '\p{{L}}+$', '') ELSE l END
    || chr(10) || CASE WHEN regexp_matches(v, '\p{{L}}$') THEN regexp_replace(r, '^\p{{L}}+', '') ELSE r END AS near
  FROM (SELECT *, CASE WHEN length(before) > 64 THEN regexp_replace(right(before, 64), '^\p{{L}}+', '') ELSE before END AS l,
    CASE WHEN length(after) > 64 THEN regexp_replace(left(after, 64), '\p{{L}}+$', '') ELSE after END AS r FROM base)
), pairs AS MATERIALIZED (
  SELECT kind, entity, term, count(DISTINCT key) AS n_both FROM (SELECT key, kind, entity, unnest(regexp_extract_all(lower(near), '\p{{L}}+')) AS term FROM beside)
  WHERE length(term) >= 3 GROUP BY ALL HAVING count(DISTINCT key) >= 3
), held AS MATERIALIZED (
  SELECT DISTINCT key, term FROM (SELECT key, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM texts) WHERE term IN (SELECT term FROM pairs)
), judged AS (
  SELECT term, kind, round(1 + log2(n_both / n_term) / nullif(log2((SELECT count(*) FROM texts WHERE text <> '') / n_entity), 0), 9) AS disclosed
  FROM pairs JOIN (SELECT entity, count(DISTINCT key) AS n_entity FROM base GROUP BY entity) USING (entity) JOIN (SELECT term, count(*) AS n_term FROM held GROUP BY term) USING (term)
), disclosing AS (SELECT DISTINCT term FROM judged WHERE disclosed >= 0.95),
words AS (
  SELECT m.key, place, kind, start, start + length(v) AS stop FROM ({_sql_matches("(SELECT * FROM texts WHERE key IN (SELECT key FROM held WHERE term IN (SELECT term FROM disclosing)))", 4, "term", chr(92) + "p{L}+")}) m
  WHERE lower(v) IN (SELECT term FROM disclosing) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.key = m.key AND b.start < m.start + length(m.v) AND m.start < b.stop)
), spans AS (
  SELECT key, place, kind, start, kind || ':' || start || ':' || stop AS said FROM (SELECT key, place, kind, start, stop FROM base UNION ALL SELECT * FROM words)
), joined AS (
  SELECT key, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    sha256(coalesce(string_agg(said, ',' ORDER BY start, place) FILTER (kind <> 'term'), '')) AS base_sha256, string_agg(said, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY key
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (key)
"""


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, folder, "documents"))


# crc32 from its polynomial; words one edit apart by masked letters and by deletions, without any reduced alphabet.
OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT run, n, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS b FROM (SELECT *, hex(id || ':' || run) AS h FROM runs)
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) % 256 AS INTEGER) + 1])), 4294967295) AS h FROM bytes, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), shorter AS (SELECT DISTINCT c.word AS a, c.n AS na, w.word AS b, w.n AS nb FROM cut c JOIN words w ON w.word = c.head || c.tail),
near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION ALL SELECT a, na, b, nb FROM shorter UNION ALL SELECT b, nb, a, na FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS place, 0 AS step FROM forms UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.place WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, last(place ORDER BY step) AS root FROM walk GROUP BY word) USING (word)
"""


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_token_counts": op9_token_counts,
    "op10_html_text": op10_html_text,
    "op11_vector_codes": op11_vector_codes,
    "op12_pii_sanitise": op12_pii_sanitise,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE = {"op2_chat_format": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op8_mix_sources": mix_sql(), "op11_vector_codes": OP11_SQL, "op12_pii_sanitise": OP12_SQL, "op13_spelling_variants": OP13_SQL}
