"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.functions import vectors as V
from clickloom.operators import fit, lookups
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, IMPRESSIONS, behaviour, fixed, fixed_sql, ids, impressions, table
from clickloom.spec import CategoryField, ProfileField, Source, TokensField


@query(
    "join_left_keys",
    f"""WITH {BEHAVIOUR}, prof AS (SELECT dt, user_id, count(*) AS n_view FROM behaviour WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT event_id, b.dt, b.user_id, n_view FROM behaviour b LEFT JOIN prof USING (dt, user_id)""",
)
def join_left_keys(spark, sf):
    b = behaviour(spark, sf)
    prof = b.where(F.col("event_type") == "view").groupBy("dt", "user_id").agg(F.count(F.lit(1)).alias("n_view"))
    return b.select("event_id", "dt", "user_id").join(prof, ["dt", "user_id"], "left")


PROFILE_FIELDS = [
    ProfileField("u_nation", -1, "Int", Source("user_id", 10001, "nation")),
    ProfileField("i_owner_nation", -1, "Int", Source("item_owner_id", 10001, "nation")),
    ProfileField("u_acctbal", 0.0, "Float32", Source("user_id", 10001, "acctbal")),
    ProfileField("i_size", 0, "Int", Source("item_id", 10101, "size")),
    ProfileField("e_source", "", "String", Source("ctx", 0, "source")),
]


@query(
    "join_profiles",
    f"""WITH {IMPRESSIONS} SELECT order_id, line_no, item_id, coalesce(u.c_nationkey, -1) AS u_nation,
    coalesce(o.c_nationkey, -1) AS i_owner_nation, CAST(coalesce(u.c_acctbal, 0) AS FLOAT) AS u_acctbal,
    coalesce(CASE WHEN p_size > 5 THEN p_size END, 0) AS i_size, source AS e_source
    FROM impressions LEFT JOIN customer u ON user_id = u.c_custkey LEFT JOIN customer o ON owner_id = o.c_custkey
    LEFT JOIN part ON item_id = p_partkey""",
)
def join_profiles(spark, sf):
    """The same profile table plays the user and the owner role."""
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal")
    )
    items = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    out = lookups.join_profiles(
        impressions(spark, sf),
        PROFILE_FIELDS,
        {10001: customers, 10101: items},
        {"user_id": "user_id", "item_owner_id": "owner_id", "item_id": "item_id"},
    )
    return out.select("order_id", "line_no", "item_id", *[f.name for f in PROFILE_FIELDS])


NAMES = """counts AS (SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1),
  vocab AS (SELECT value, row_number() OVER (ORDER BY count DESC, value) AS idx FROM counts WHERE count >= 30)"""


@query(
    "vocab_lookup_join",
    f"WITH {NAMES} SELECT p_partkey, p_name, CAST(coalesce(idx, 0) AS INT) AS idx FROM part LEFT JOIN vocab ON p_name = value",
)
def vocab_lookup_join(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    vocab = fit.fit_vocab(parts, [CategoryField("p_name", min_cnt=30)])
    return lookups.index_by_vocab(parts, "p_name", vocab, "idx")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))


VECS = "vecs AS (SELECT vec_id AS idx, embedding AS vec FROM embeddings)"


@query(
    "embedding_lookup",
    f"""WITH {BEHAVIOUR}, {VECS} SELECT event_id, {fixed_sql('a.vec')} AS item_vec, {fixed_sql('b.vec')} AS user_vec
    FROM behaviour LEFT JOIN vecs a ON item_id = a.idx LEFT JOIN vecs b ON user_id = b.idx""",
)
def embedding_lookup(spark, sf):
    """Item and user ids share one embedding table."""
    rows = behaviour(spark, sf).select("event_id", "item_id", "user_id")
    shared = _vectors(spark, sf).select("idx", "vec")
    out = lookups.embedding_lookup(rows, "item_id", shared, "item_vec")
    out = lookups.embedding_lookup(out, "user_id", shared, "user_vec")
    return out.select("event_id", fixed("item_vec").alias("item_vec"), fixed("user_vec").alias("user_vec"))


WORD_VOCAB = """words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w,
    generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
  wv AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS idx FROM words GROUP BY 1),
  steps AS (SELECT p_partkey, pos, idx, coalesce(embedding, [0::FLOAT for i in range((SELECT max(len(embedding)) FROM embeddings))]) AS vec
    FROM words JOIN wv USING (w) LEFT JOIN embeddings ON vec_id = idx)"""


def word_rows(spark, sf, max_len=2**31 - 1):
    """Parts with indexed name words and their vectors."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    vocab = fit.fit_vocab(parts, [TokensField("p_name", sep=" ", max_len=max_len)])
    rows = lookups.index_tokens_by_vocab(
        parts, ["p_partkey"], C.tokens("p_name", " "), vocab, "word_ids", max_len, pad=False
    )
    shared = _vectors(spark, sf).select("idx", F.col("vec").cast("array<double>").alias("vec"))
    return lookups.varlen_embedding_lookup(rows, ["p_partkey"], "word_ids", shared, "word_vecs")


@query(
    "varlen_embedding_lookup",
    f"""WITH {WORD_VOCAB} SELECT p_partkey, array_to_string(list(idx ORDER BY pos), ',') AS word_ids,
    array_to_string(list({fixed_sql('vec')} ORDER BY pos), ';') AS word_vecs FROM steps GROUP BY 1""",
)
def varlen_embedding_lookup(spark, sf):
    rows = word_rows(spark, sf)
    return rows.select(
        "p_partkey",
        ids("word_ids").alias("word_ids"),
        F.array_join(F.transform("word_vecs", fixed), ";").alias("word_vecs"),
    )


@query(
    "pretrained_embedding",
    f"""WITH m AS (SELECT list(a ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS a FROM (
        SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)),
    v AS (SELECT CAST(item AS VARCHAR) AS value, row_number() OVER (ORDER BY count(*) DESC, CAST(item AS VARCHAR)) AS idx
        FROM (SELECT l_partkey AS item FROM lineitem) GROUP BY item)
    SELECT CAST(0 AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS value, {fixed_sql('mean')} AS vec FROM m
    UNION ALL SELECT v.idx, v.value, {fixed_sql('coalesce(CAST(embedding AS DOUBLE[]), mean)')}
    FROM v CROSS JOIN m LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = v.value AND vec_id <> 0""",
)
def pretrained_embedding(spark, sf):
    """Vectors for every shown item; items without a stored vector get the mean."""
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("item"))
    vocab = fit.fit_vocab(items, [CategoryField("item")])
    stored = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"), F.col("vec_id").alias("row")
    )
    return lookups.pretrained_matrix(vocab, stored).withColumn("vec", fixed("vec"))


@query(
    "emb_value_lookup",
    f"""WITH {IMPRESSIONS}, d AS (SELECT embedding AS dv FROM embeddings WHERE vec_id = 7)
    SELECT order_id, line_no, item_id, {fixed_sql('coalesce(e.embedding, dv)')} AS vec FROM impressions
    CROSS JOIN d LEFT JOIN embeddings e ON vec_id = item_id AND vec_id <> 7""",
)
def emb_value_lookup(spark, sf):
    """Vector 7 plays the entry stored under the default key '-1'."""
    key = F.when(F.col("vec_id") == 7, "-1").otherwise(F.col("vec_id").cast("string"))
    stored = table(spark, sf, "embeddings").select(key.alias("key"), F.col("embedding").alias("vec"))
    rows = impressions(spark, sf).select("order_id", "line_no", "item_id")
    return lookups.emb_value_lookup(rows, "item_id", stored, "vec").withColumn("vec", fixed("vec"))


@query("str_to_vec", f"SELECT vec_id, {fixed_sql('embedding')} AS vec FROM embeddings")
def str_to_vec(spark, sf):
    text = F.array_join(F.col("embedding").cast("array<string>"), ",")
    rows = table(spark, sf, "embeddings").select("vec_id", text.alias("text"))
    return rows.select("vec_id", fixed(V.str_to_vec("text", 64)).alias("vec"))


@query(
    "cosine_pair",
    f"""WITH {BEHAVIOUR}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE
      round(list_dot_product(u.e, i.e) / (sqrt(list_dot_product(u.e, u.e)) * sqrt(list_dot_product(i.e, i.e))), 6) END AS cos
    FROM behaviour JOIN v u ON user_id = u.vec_id JOIN v i ON item_id = i.vec_id""",
)
def cosine_pair(spark, sf):
    """User and item vector side by side; error rows get a zero item vector."""
    rows = behaviour(spark, sf).select("event_id", "event_type", "item_id", "user_id")
    shared = _vectors(spark, sf)
    out = lookups.embedding_lookup(rows, "user_id", shared, "u")
    out = lookups.embedding_lookup(out, "item_id", shared, "i")
    item = F.when(F.col("event_type") == "error", V.zeros(64)).otherwise(V.doubles("i"))
    return out.where(F.col("u").isNotNull() & F.col("i").isNotNull()).select(
        "event_id", F.round(V.cosine_halves(V.concat("u", item), 64), 6).alias("cos")
    )
