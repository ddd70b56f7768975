"""The subpackage's queries over the tables of a folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from public_tokenizers import PATTERN

    from thicket.llm.token_counts import section_tokens

    return section_tokens(_table(spark, sf_dir, "documents"), path or tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from thicket.llm.bpe import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path or tokenizer_path("word_bpe_49k.json"), ids=False, digests=True, keep_text=False)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.langid import fit, held_out, identify

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False)


def op7_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from thicket.llm.token_files import read_token_files, token_folder, write_token_files

    docs = _table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, token_folder(spark), path or tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.pii import replace_pii

    return replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The contract's rules.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.url_filter import PATTERNS, judge, rule_table

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, HOST_RULES, PATTERNS)).drop("url")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.ann import neighbours

    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.toxicity import fit, held_out, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), model, keep_text=False)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.vector_codes import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.conversation_trie import prefix_trie, rerooted, turn_arrays

    return prefix_trie(rerooted(turn_arrays(_table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_token_counts, op3_decontaminate, op4_bpe_roundtrip, op5_simhash, op6_langid, op7_token_files, op8_pii, op9_url_filter, op10_ann, op11_toxicity, op12_vector_codes, op13_conversation_trie, pipeline)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _vector_codes_sql(rounds: int = 6) -> str:
    """Every round as a table of nearest entries and one of moved entries."""
    near = """
near{r} AS MATERIALIZED (SELECT vec_id, k, arg_min({{'e': e, 'far': far}}, {{'far': far, 'e': e}}) AS best
    FROM (SELECT p.vec_id, k, e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM parts AS p JOIN book{r} AS b USING (k)) GROUP BY vec_id, k),"""
    move = """
mean{q} AS (SELECT k, e, list(m ORDER BY i) AS x FROM (SELECT k, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM near{r} JOIN parts USING (vec_id, k), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY k, e),
book{q} AS MATERIALIZED (SELECT b.k, b.e, coalesce(mean{q}.x, b.x) AS x FROM book{r} AS b LEFT JOIN mean{q} USING (k, e)),"""
    chain = "".join(near.format(r=r) + move.format(r=r, q=r + 1) for r in range(rounds)) + near.format(r=rounds)
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT vec_id, k, x[k * len(x) // 8 + 1:(k + 1) * len(x) // 8] AS x FROM kept, unnest(range(8)) AS u(k)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16),
book0 AS MATERIALIZED (SELECT k, e, x FROM first JOIN parts USING (vec_id)),{chain}
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS s FROM book{rounds}),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY k) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha"""


ORACLE: dict[str, str] = {
    "op12_vector_codes": _vector_codes_sql(),
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
        FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
          FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, g.n, item_id FROM grams AS g JOIN win USING (n, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op9_url_filter": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u, position('://' IN coalesce(url, '')) AS p FROM pages),
s AS (SELECT page_id, CASE WHEN p = 0 THEN '' ELSE substr(u, p + 3) END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
rules(action, rule, rh, rp) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
f AS (SELECT page_id, host, path, arg_min(rule, (-length(rule), rule)) AS rule, arg_min(action, (-length(rule), rule)) AS action
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path),
pats(pattern, re) AS (VALUES ('||ads-', '^(?:[^/]*\.)?ads-'), ('||adult-', '^(?:[^/]*\.)?adult-'), ('||casino-', '^(?:[^/]*\.)?casino-'), ('||cheap-', '^(?:[^/]*\.)?cheap-'), ('||free-', '^(?:[^/]*\.)?free-'), ('||spam-', '^(?:[^/]*\.)?spam-'), ('||tracker-', '^(?:[^/]*\.)?tracker-'), ('||porn-', '^(?:[^/]*\.)?porn-'), ('||ads.', '^(?:[^/]*\.)?ads\.'), ('||adserver.', '^(?:[^/]*\.)?adserver\.')),
g AS (SELECT page_id, min(pattern) AS pattern FROM h JOIN pats ON regexp_matches(host || path, re) AND host <> '' GROUP BY page_id)
SELECT h.page_id, h.host, h.path, f.rule, g.pattern, coalesce(f.action, CASE WHEN g.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h LEFT JOIN f ON h.page_id = f.page_id LEFT JOIN g ON h.page_id = g.page_id""",
    "op13_conversation_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS t FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
               lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295) AS crc FROM c),
b AS (SELECT c.conv_id, list_concat(coalesce(base.t[1:xor(crc, 4294967295) % 4], []), c.t[xor(crc, 4294967295) % 4 + 1:]) AS t
      FROM c JOIN crc ON c.conv_id = crc.conv_id LEFT JOIN c AS base ON base.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, t[1:d] AS k, len(t) = d AS ended FROM b, unnest(range(0, len(t) + 1)) AS u(d)),
n AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM p GROUP BY k, d),
kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (SELECT n.k, depth, n_children IS NULL AS leaf, (n_convs - 1) * CASE WHEN depth > 0 THEN len(regexp_extract_all(n.k[depth].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN kids ON n.k = kids.k),
sub AS (SELECT k[1:a] AS k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM w, unnest(range(0, depth + 1)) AS u(a) GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN sub ON n.k = sub.k LEFT JOIN kids ON n.k = kids.k LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.k = n.k[1:n.depth - 1]""",
}
