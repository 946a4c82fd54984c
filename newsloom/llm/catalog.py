"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.context_trees import score_texts
from newsloom.llm.decontaminate import contaminated
from newsloom.llm.language import predicted_languages
from newsloom.llm.lexical_search import ranked_documents
from newsloom.llm.licenses import scan_licenses
from newsloom.llm.mixing import mix_sources
from newsloom.llm.near_duplicates import near_duplicates
from newsloom.llm.page_text import page_texts
from newsloom.llm.suffix_dedup import removal_digests
from newsloom.llm.token_files import token_digests
from newsloom.llm.vector_duplicates import vector_duplicates
from newsloom.llm.warc import archived_pages
from newsloom.llm.whitening import whitened
from newsloom.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold: at least 80 % of the item's 5-word shingles."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "item_shingles")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, for sources weighing 1, 2, 3 in turn."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without bytes of repeated 400-byte strings."""
    return removal_digests(table(spark, sf_dir, "documents"), min_bytes=400)


def op4_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all texts, learned from six sevenths of them."""
    return score_texts(table(spark, sf_dir, "documents"))


def op5_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of a label: cosine of 0.98 and more."""
    return vector_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return archived_pages(table(spark, sf_dir, "pages"), min_bytes=0)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 4-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return predicted_languages(table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_texts(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=10)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in frequency-ranked variable-length files and read back."""
    return token_digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the 16 leading eigenvectors of their covariance."""
    return whitened(table(spark, sf_dir, "embeddings"), components=16)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_context_trees": op4_context_trees,
    "op5_vector_duplicates": op5_vector_duplicates,
    "op6_warc": op6_warc,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_licenses": op8_licenses,
    "op9_language": op9_language,
    "op10_page_text": op10_page_text,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_files": op12_token_files,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op1_decontaminate": r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')
  FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(sizes.n) AS item_shingles
FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(sizes.n)""",
    # all pairs of a label
    "op5_vector_duplicates": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding,
    lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links, min(r.b) AS component_id,
  r.a = min(r.b) AS kept
FROM reach r GROUP BY r.a""",
    # SHA-1 as base32: each of the 32 letters is five bits of the digest
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110',
    '0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x[i:i])]), '') AS b,
    min(page_id) OVER (PARTITION BY h) AS least
  FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(
    1 + 16 * (b[5 * i + 1:5 * i + 1])::INT + 8 * (b[5 * i + 2:5 * i + 2])::INT + 4 * (b[5 * i + 3:5 * i + 3])::INT
    + 2 * (b[5 * i + 4:5 * i + 4])::INT + (b[5 * i + 5:5 * i + 5])::INT)::INT]), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM bits""",
    # documents that share a shingle, by the size of what they share
    "op7_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a""",
    # these pages' articles: what stands between paragraph and heading tags
    "op10_page_text": r"""
WITH blocks AS (
  SELECT page_id, url, list_transform(string_split_regex(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
      '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b
  FROM pages),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts""",
    # every document's score for every item
    "op11_ranked_search": r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents
  UNION ALL
  SELECT 'i', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
  FROM benchmark),
d AS (SELECT id, t, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY id, t),
i AS (SELECT id, t, count(*) AS times FROM words WHERE kind = 'i' GROUP BY id, t),
sizes AS (SELECT id, sum(tf)::BIGINT AS n FROM d GROUP BY id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
m AS (SELECT id, 25 + ((75 * n * docs) // length) AS m FROM sizes, whole),
w AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM d, whole WHERE t IN (SELECT t FROM i) GROUP BY t),
scores AS (
  SELECT i.id AS item_id, d.id AS doc_id, sum(i.times * w.w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m.m)))::BIGINT AS score
  FROM i JOIN w ON i.t = w.t JOIN d ON d.t = i.t JOIN m ON m.id = d.id GROUP BY i.id, d.id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}
