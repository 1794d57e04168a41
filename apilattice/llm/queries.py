"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where it has any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.llm import bpe, chat, conversation_trie, embedding_lsh, html_blocks, mixing, ngram_join, suffix_dedup, topk_search, toxicity, url_cascade, warc, whitening
from apilattice.llm.staging import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op1_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(read(spark, sf_dir, "pages"))


@query
def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.unionByName(extra)))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).drop("text_hash")


@query
def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, F.col("vec_id") % 50 == 0)


@query
def op9_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = table(warc.write(read(spark, sf_dir, "pages")), "warc", compression="uncompressed")
    return warc.sound(warc.read(archives, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


@query
def op7_html_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read(spark, sf_dir, "pages"))


@query
def op10_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(read(spark, sf_dir, "conversations"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(read(spark, sf_dir, "documents"))


# --- SQL for the same rows, where SQL can express them ---------------------------------------

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_sql() -> str:
    rules = sorted(url_cascade.RULES, key=lambda r: -len(r[1]))
    fits = lambda name, start: f"(host = '{name}' OR host LIKE '%.{name}')" + (f" AND starts_with(path, '{start}')" if start else "")
    case = lambda value: " ".join(f"WHEN {fits(text.partition('/')[0], '/' + text.partition('/')[2])} THEN '{value(action, text)}'" for action, text in rules)
    listed = " OR ".join(fits(name, "") for name in url_cascade.LISTED)
    return f"""WITH u AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
SELECT page_id, host, path, CASE {case(lambda a, r: r)} END AS rule, CASE {case(lambda a, r: a)} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM u"""


ORACLES["op1_url_bloom_cascade"] = _url_sql()

ORACLES["op2_ngram_jaccard_join"] = rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = d.doc_id"""

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"

ORACLES["op4_chat_windows"] = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER o AS pos, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tok, length({_ESC.format("role")}) + length({_ESC.format("text")}) AS size FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id) AS sys, sum(tok) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM t),
z AS (SELECT *, coalesce(max(CASE WHEN pos = sys THEN tok END) OVER (PARTITION BY conv_id), 0) AS sys_tok, max(CASE WHEN pos = sys THEN size END) OVER (PARTITION BY conv_id) AS sys_size FROM s),
r AS (SELECT *, CASE WHEN sys_tok < {chat.BUDGET} THEN {chat.BUDGET} - sys_tok ELSE {chat.BUDGET} END AS room FROM z),
h AS (SELECT *, (upto - 1) // greatest(room // 2, 1) AS cell, (upto - 1) // greatest(room // 2, 1) * greatest(room // 2, 1) - (upto - tok) > room // 4 AS lone FROM r),
k AS (SELECT *, pos > 1 AND (lone OR lag(lone) OVER o OR lag(cell) OVER o <> cell) AS opens, CASE WHEN lone THEN least(room // 4, room - tok) ELSE room // 4 END AS spare,
  lag(pos, 1) OVER o AS p1, lag(tok, 1) OVER o AS t1, lag(size, 1) OVER o AS z1, lag(pos, 2) OVER o AS p2, lag(tok, 2) OVER o AS t2, lag(size, 2) OVER o AS z2 FROM h WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
f AS (SELECT *, 20 + size + CASE WHEN opens THEN
    CASE WHEN sys < pos THEN 21 + sys_size ELSE 0 END
    + CASE WHEN p1 <> coalesce(sys, 0) AND t1 <= spare THEN 21 + z1 + CASE WHEN p2 <> coalesce(sys, 0) AND t1 + t2 <= spare THEN 21 + z2 ELSE 0 END ELSE 0 END
  ELSE 0 END AS chars FROM k)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""

ORACLES["op8_pivot_topk"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.z, v.z) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""

ORACLES["op9_embedding_lsh"] = """WITH RECURSIVE
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, coalesce(b, vec_id) >= vec_id AS kept
FROM e LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id"""

_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"

ORACLES["op11_conversation_trie"] = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns, {_CRC} % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, turns[1:d] AS path, CAST(d AS BIGINT) AS depth, d = len(turns) AS ended FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ended THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
  (count(*) - 1) * CASE WHEN any_value(depth) = 0 THEN 0 ELSE len(regexp_extract_all(any_value(path)[any_value(depth)].text, '[^\x20\x09-\x0D]+')) END AS saved FROM p GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS many FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.many, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN n u ON u.path = f.path[1:f.depth - 1] AND f.depth > 0"""

ORACLES["op13_suffix_dedup"] = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
e AS (SELECT r, doc_id, c, substring(x, 2000 * c + 1, 2098) AS x FROM (SELECT *, unnest(range(0, len(x) // 2000 + 1)) AS c FROM d WHERE doc_id IS NOT NULL)),
w AS (SELECT r, doc_id, 1000 * c + p AS p, substring(x, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(1000, len(x) // 2 - 49))) AS p FROM e)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT w.r, w.p FROM w JOIN f ON f.s = w.s WHERE w.doc_id > f.low),
g AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS span FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM c)),
a AS (SELECT r, span, min(p) AS lo, max(p) + 50 AS hi FROM g GROUP BY r, span),
b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS was FROM a),
k AS (SELECT b.r, string_agg(substring(x, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) AS head, max(hi) AS hi, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM b JOIN d ON d.r = b.r GROUP BY b.r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(hi, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r"""
