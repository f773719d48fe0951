"""Registered queries of this subpackage: thin steps from the driver tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def notes_of(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``documents`` as observations: the document id and its whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("obs_id"), F.col("text").alias("note"), *more)


def back(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("obs_id", "doc_id")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.token_counts import count_tokens

    return back(count_tokens(notes_of(spark, sf_dir), vocabulary("word_bpe_49k.json"), limit=2048))


@query("op7_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.packing import pack_notes

    return back(pack_notes(notes_of(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2, room=4096))


@query("op10_bpe_codec")
def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.lexicon import encode_notes

    return back(encode_notes(notes_of(spark, sf_dir), vocabulary("byte_bpe_50k.json"), keep_ids=False))


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.languages import detect_language, fit_languages
    from emberline.llm.samples import in_fold

    notes = notes_of(spark, sf_dir, F.col("lang").alias("language"))
    model = fit_languages(notes.where(~in_fold("obs_id")))
    found = detect_language(notes, model)
    return back(found.select("obs_id", in_fold("obs_id").alias("held_out"), "lang_pred", "score"))


@query("op8_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.quality import fit_quality, score_notes
    from emberline.llm.samples import in_fold

    notes = notes_of(spark, sf_dir)
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("obs_id"), F.col("quality").alias("reliable"))
    model = fit_quality(notes, ratings.where(~in_fold("obs_id")))
    scored = score_notes(notes, model, keep_from=0.3)
    return back(scored.select("obs_id", in_fold("obs_id").alias("held_out"), "score", "predicted"))


@query("op9_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.simhash import group_notes

    return back(group_notes(notes_of(spark, sf_dir), shingle_words=4, radius=4))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS pos, w FROM words WHERE len(w) >= 35
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS h FROM places
), again AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 35)))) AS g FROM windows SEMI JOIN again USING (h) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""


@query("op2_substring_dedup", OP2_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.passages import drop_repeated_passages

    kept = drop_repeated_passages(notes_of(spark, sf_dir), window=35)
    return back(kept.select("obs_id", "n_words", "n_removed", F.sha2("note", 256).alias("kept_sha256")))


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n FROM documents
), ring AS (
  SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM docs
), edited AS (
  SELECT *, left(t, n - n // 3) || left(nt, n // 3) AS e FROM ring
), texts AS (
  SELECT doc_id, 0 AS k, t AS x FROM edited UNION ALL SELECT doc_id, 1, e FROM edited UNION ALL SELECT doc_id, 2, nt FROM edited
), words AS (
  SELECT doc_id, k, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM texts
), hashed AS (
  SELECT doc_id, k, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 12)) END AS h FROM words
), sketch AS (
  SELECT doc_id, k, CASE WHEN len(h) = 0 THEN h WHEN len(list_filter(h, lambda x: x < '400000000000')) = 0 THEN [list_min(h)]
    ELSE list_sort(list_distinct(list_filter(h, lambda x: x < '400000000000'))) END AS s FROM hashed
), wide AS (
  SELECT doc_id, max(s) FILTER (k = 0) AS a, max(s) FILTER (k = 1) AS b, max(s) FILTER (k = 2) AS c FROM sketch GROUP BY doc_id
)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END::DOUBLE AS near_edited,
  CASE WHEN len(a) = 0 AND len(c) = 0 THEN 1.0 WHEN least(len(a), len(c)) = 0 THEN 0.0 ELSE len(list_intersect(a, c)) / least(len(a), len(c)) END::DOUBLE AS near_next
FROM edited JOIN wide USING (doc_id)
"""


@query("op1_fingerprints", OP1_SQL)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.fingerprints import fingerprint_edits

    return back(fingerprint_edits(notes_of(spark, sf_dir), fraction=0.25, shingle_words=5))


OP6_SQL = r"""
WITH good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id JOIN reach ON reach.a = vec_id
"""


@query("op6_vector_dedup", OP6_SQL)
def vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.vectors import near_duplicate_cells

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = table.select(F.col("vec_id").alias("cell_id"), F.col("label").alias("fire"), F.col("embedding").alias("features"))
    return near_duplicate_cells(cells, least=0.93).withColumnRenamed("cell_id", "vec_id")


@query("op3_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.lines import drop_recurring_lines

    kept = drop_recurring_lines(notes_of(spark, sf_dir))
    return back(kept.select("obs_id", "n_lines", "n_dropped", F.sha2("note", 256).alias("kept_sha256")))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS low FROM d
), f AS (
  SELECT doc_id, part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
  FROM w
), rated AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), p AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN rated USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders
), judged AS (
  SELECT *, filter_order[step] AS letter, contains(fails, filter_order[step]) AS failing,
    translate(filter_order[1:step - 1], fails, '') = filter_order[1:step - 1] AS there
  FROM p, steps
), r AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (there AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (there AND failing), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (NOT there AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (there AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (there AND failing), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""


@query("op12_filter_audit", OP12_SQL)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.audit import audit_filters

    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = ratings.select(F.col("doc_id").alias("obs_id"), F.col("quality").alias("reliable"), F.col("toxic").alias("harmful"))
    return audit_filters(notes_of(spark, sf_dir, "source"), ratings)


@query("op13_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.nearest import nearest_cells

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = table.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("features"))
    found = nearest_cells(cells, cells.where(F.col("cell_id") % 100 == 0), k=10)
    return found.select(F.col("cell_id").alias("query_id"), "rank", F.col("neighbour").alias("vec_id"), F.col("distance").alias("score"))


OP11_SQL = r"""
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    length(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list({'t': md5(t), 'words': words} ORDER BY pos) AS turns FROM ordered GROUP BY conv_id
), crc_table AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)
), steps AS (SELECT list(v ORDER BY i) AS v FROM crc_table
), heads AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii((conv_id::VARCHAR)[k])::BIGINT)),
    lambda c, b: xor(c // 256, v[xor(c, b) % 256 + 1])), 4294967295) % 4 AS h FROM lists, steps
), rebuilt AS (
  SELECT a.conv_id, coalesce(b.turns[1:h], []) || a.turns[h + 1:] AS turns
  FROM lists a JOIN heads USING (conv_id) LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 20
), rows AS (
  SELECT conv_id, depth, md5(array_to_string(list_transform(turns[1:depth], lambda x: x.t), '')) AS k, turns[depth].words AS words,
    CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(turns[1:depth - 1], lambda x: x.t), '')) END AS pk, len(turns) = depth AS last
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT depth, k, pk, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(words), 0) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM rows GROUP BY depth, k, pk
), full_nodes AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0)::BIGINT AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = n.pk LEFT JOIN (SELECT depth, pk, count(*) AS n FROM nodes GROUP BY ALL) c ON c.depth = n.depth + 1 AND c.pk = n.k
), sums AS (
  SELECT r.depth, r.k, sum((v.n_children = 0)::INT)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens
  FROM full_nodes v JOIN rows r ON r.conv_id = v.conv_id AND r.depth <= v.depth GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_nodes JOIN sums USING (depth, k)
"""


@query("op11_prefix_trie", OP11_SQL)
def conversation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.prefixes import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), group=20, shared=3)
