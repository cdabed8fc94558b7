"""Category, token and sequence transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.functions import vectors as V
from clickloom.operators import fit, lookups
from clickloom.plans.q_joins import WORD_VOCAB, word_rows
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, IMPRESSIONS, behaviour, field_vectors, field_vectors_sql, fixed, fixed_sql, ids, impressions, table
from clickloom.spec import CategoryField

TYPES = ("view", "click", "purchase")


@query(
    "index_sparse",
    f"""WITH {IMPRESSIONS}, v AS (SELECT CAST(owner_id AS VARCHAR) AS value, row_number() OVER (ORDER BY count(*) DESC, CAST(owner_id AS VARCHAR)) AS idx
      FROM impressions GROUP BY owner_id HAVING count(*) >= 600)
    SELECT order_id, line_no, item_id, CAST(coalesce(idx, 0) AS INT) AS owner_idx,
      CASE source WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS source_idx
    FROM impressions LEFT JOIN v ON CAST(owner_id AS VARCHAR) = value""",
)
def index_sparse(spark, sf):
    """A fitted vocabulary through a join, a short given one through a literal."""
    rows = impressions(spark, sf).select("order_id", "line_no", "item_id", "owner_id", "source")
    vocab = fit.fit_vocab(rows, [CategoryField("owner_id", default="-1", min_cnt=600)])
    out = lookups.index_by_vocab(rows, "owner_id", vocab, "owner_idx")
    return out.withColumn("source_idx", C.index_literal("source", ("1-URGENT", "2-HIGH"))).drop("owner_id", "source")


@query(
    "hash_bucket",
    f"""WITH {IMPRESSIONS} SELECT user_id, item_id, CAST(('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT % 1000 AS INT) AS user_bucket,
    CAST(CASE WHEN item_id = 0 THEN 0 ELSE ('0x' || substr(md5(item_id::VARCHAR), 1, 15))::BIGINT % 999 + 1 END AS INT) AS item_bucket FROM impressions""",
)
def hash_bucket(spark, sf):
    return impressions(spark, sf).select(
        "user_id", "item_id",
        C.hash_bucket("user_id", 1000).alias("user_bucket"),
        C.hash_bucket("item_id", 1000, mask_zero=True).alias("item_bucket"),
    )


SEVEN = ("red", "green", "blue", "small", "large", "plate", "ring")
SEVEN_SQL = "coalesce(list_position(['red','green','blue','small','large','plate','ring'], t), 0)"


@query(
    "split_pad_index",
    f"""SELECT p_partkey, array_to_string(list_resize([{SEVEN_SQL} for t in string_split(p_name, ' ')][1:5], 5, 0), ',') AS ids FROM part""",
)
def split_pad_index(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ids(C.split_pad_index("p_name", SEVEN, 5, " ")).alias("ids"))


@query(
    "split_pad_number",
    f"""WITH {BEHAVIOUR} SELECT event_id, CASE WHEN event_type = 'error' THEN '0,0,0,0' ELSE
    item_id || ',' || user_id || ',' || day || ',0' END AS nums FROM behaviour""",
)
def split_pad_number(spark, sf):
    text = F.when(F.col("event_type") == "error", "").otherwise(F.concat_ws(",", "item_id", "user_id", "day"))
    return behaviour(spark, sf).select("event_id", ids(C.split_pad_number(text, 4).cast("array<int>")).alias("nums"))


@query(
    "split_varlen_v2",
    """SELECT p_partkey, array_to_string([coalesce(list_position(['', 'red', 'green', 'ring'], t), 0)
      for t in list_resize(string_split(p_name, ' ')[1:4], 4, '')], ',') AS ids FROM part""",
)
def split_varlen_v2(spark, sf):
    """'' is in the vocabulary, so padding gets its index."""
    return table(spark, sf, "part").select(
        "p_partkey", ids(C.split_index_v2("p_name", ("", "red", "green", "ring"), 4)).alias("ids")
    )


PADDED = f"list_resize([{SEVEN_SQL} for t in string_split(p_name, ' ')][1:4], 4, 0)"


@query(
    "seq_mask",
    f"""SELECT p_partkey, array_to_string([CAST(i <> 0 AS INT) for i in {PADDED}], ',') AS mask,
    array_to_string([CAST(i <= p_size % 5 AS INT) for i in [1,2,3,4]], ',') AS by_length FROM part""",
)
def seq_mask(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        ids(C.seq_mask(C.split_pad_index("p_name", SEVEN, 4, " "))).alias("mask"),
        ids(C.length_mask(F.col("p_size") % 5, 4)).alias("by_length"),
    )


@query("seq_length", f"SELECT p_partkey, CAST(len(list_filter({PADDED}, lambda i: i <> 0)) AS INT) AS n FROM part")
def seq_length(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.seq_length(C.split_pad_index("p_name", SEVEN, 4, " ")).alias("n"))


@query(
    "one_hot",
    f"""WITH {BEHAVIOUR} SELECT event_id, CASE event_type WHEN 'view' THEN '0,1,0,0' WHEN 'click' THEN '0,0,1,0'
    WHEN 'purchase' THEN '0,0,0,1' ELSE '1,0,0,0' END AS hot FROM behaviour""",
)
def one_hot(spark, sf):
    return behaviour(spark, sf).select("event_id", ids(C.one_hot(C.index_literal("event_type", TYPES), 3)).alias("hot"))


@query(
    "multi_hot",
    f"""SELECT p_partkey, array_to_string([len(list_filter({PADDED}, lambda i: i = k)) for k in [1,2,3,4,5,6,7]], ',') AS hot FROM part""",
)
def multi_hot(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", ids(C.multi_hot(C.split_pad_index("p_name", SEVEN, 4, " "), 7)).alias("hot")
    )


@query("k_max", f"SELECT vec_id, {fixed_sql('list_reverse_sort(embedding)[1:5]')} AS top FROM embeddings")
def k_max(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fixed(C.k_max("embedding", 5)).alias("top"))


@query(
    "position_encoding",
    f"""WITH {field_vectors_sql(4, 16)}, s AS (SELECT vec_id, unnest([f0, f1, f2, f3]) AS v, unnest([0, 1, 2, 3]) AS pos FROM fields),
    c AS (SELECT vec_id, pos, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM s)
    SELECT vec_id, CAST(pos AS INT) AS pos, array_to_string(list(CAST(round((x + 4.0 * CASE WHEN i % 2 = 0 THEN sin(pos / power(10000.0, 2.0 * (i // 2) / 16.0))
      ELSE cos(pos / power(10000.0, 2.0 * (i // 2) / 16.0)) END) * 1e6) AS BIGINT) ORDER BY i), ',') AS step
    FROM c GROUP BY vec_id, pos""",
)
def position_encoding(spark, sf):
    rows = field_vectors(spark, sf, 4, 16)
    encoded = V.position_encoding(F.array("f0", "f1", "f2", "f3"), 16)
    return rows.select("vec_id", F.posexplode(encoded).alias("pos", "v")).select("vec_id", "pos", fixed("v").alias("step"))


@query(
    "layer_norm",
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    m AS (SELECT vec_id, e, list_sum(e) / 64 AS mean FROM v),
    s AS (SELECT vec_id, e, mean, sqrt(list_sum([(x - mean) * (x - mean) for x in e]) / 64 + 1e-9) AS sd FROM m)
    SELECT vec_id, {fixed_sql('[(y - mean) / sd for y in e]')} AS normed FROM s""",
)
def layer_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fixed(V.layer_norm("embedding")).alias("normed"))


@query(
    "softmax_vec",
    f"""WITH v AS (SELECT vec_id, [exp(CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings)
    SELECT vec_id, {fixed_sql('[y / list_sum(e) for y in e]')} AS soft FROM v""",
)
def softmax_vec(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fixed(V.softmax("embedding")).alias("soft"))


@query(
    "concat_vec",
    f"""SELECT event_id, {fixed_sql('CAST(embedding AS DOUBLE[]) || [value, 1.0]')} AS x
    FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) JOIN embeddings ON vec_id = k""",
)
def concat_vec(spark, sf):
    rows = behaviour(spark, sf).select("event_id", "item_id", "value")
    shared = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    out = lookups.embedding_lookup(rows, "item_id", shared, "v").where(F.col("v").isNotNull())
    return out.select("event_id", fixed(V.concat("v", F.array("value", F.lit(1.0)))).alias("x"))
