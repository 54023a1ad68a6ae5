"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from barloom.llm import language, mixing, neardup, orc_ids, packing, passages, pii, quality, repair, sharding, trie, url_filter, vectors
from barloom.llm.common import table
from barloom.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_best_two_fit_packing")
def op3(spark, sf_dir):
    return packing.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


@query("op5_orc_token_ids")
def op5(spark, sf_dir):
    path = orc_ids.new_folder(spark)
    orc_ids.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return orc_ids.digest(spark, path)


@query("op8_risk_controlled_quality")
def op8(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), thin=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_entropy_balancing")
def op10(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op7_best_fit_sharding")
def op7(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


#: Classes of ``l(a, b)`` links among ``n(id)``: the smallest id reachable.
_REACH = """r(id, c) AS (SELECT id, id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id), cc AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP4_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT w.id, count(g) AS size FROM w LEFT JOIN s ON s.id = w.id GROUP BY 1),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
l AS (SELECT a, b FROM common JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * i >= 85 * (p.size + q.size - i)), {_REACH}
SELECT n.id AS doc_id, n.size AS n_shingles, component_id, n.id = component_id AS kept FROM n JOIN cc ON cc.id = n.id"""


@query("op4_tensored_minhash", OP4_SQL)
def op4(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"), k=3, percent=85)


@query("op9_weak_supervision_pii")
def op9(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


OP6_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT id FROM v),
u AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH},
k AS (SELECT a AS id, count(*) AS n FROM l GROUP BY 1)
SELECT n.id AS vec_id, coalesce(k.n, 0) AS n_links, component_id, n.id = component_id AS kept FROM n JOIN cc ON cc.id = n.id LEFT JOIN k ON k.id = n.id"""


@query("op6_metric_range_join", OP6_SQL)
def op6(spark, sf_dir):
    return vectors.classes(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query("op2_segmentation_unigrams")
def op2(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op1_collinear_chaining")
def op1(spark, sf_dir):
    return passages.repeated(table(spark, sf_dir, "documents"))


@query("op11_survivor_coalescence", OP11_SQL)
def op11(spark, sf_dir):
    return repair.report(table(spark, sf_dir, "conversations"))


@query("op12_padded_trie", OP12_SQL)
def op12(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_blocked_bloom", OP13_SQL)
def op13(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.spam_list(pages))
