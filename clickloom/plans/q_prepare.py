"""Projection, filter, cast, fill and expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import categorical as C
from clickloom.functions import expressions as X
from clickloom.operators import apply as A
from clickloom.operators import fit
from clickloom.operators import prepare as P
from clickloom.plans.registry import query
from clickloom.plans.views import BEHAVIOUR, IMPRESSIONS, behaviour, fixed, ids, impressions, table
from clickloom.spec import CategoryField, DeclaredColumn, DatasetSpec, DenseField, TokensField, VectorField

SPEC = DatasetSpec(
    labels=(DeclaredColumn("label_enter", "int32"), DeclaredColumn("label_convert", "int32")),
    features=(
        DeclaredColumn("amount", "float32"),
        DeclaredColumn("duration", "int32"),
        DeclaredColumn("item_id", "int64"),
        DeclaredColumn("tag", "string"),
        DeclaredColumn("source", "string"),
    ),
    passthrough=(DeclaredColumn("dt", "string"),),
    versions={"v1": ("tag", "duration", "item_id")},
)


@query(
    "select_spec",
    f"""WITH {IMPRESSIONS} SELECT label_convert, tag, CAST(trunc(duration) AS INT) AS duration, item_id, dt,
    CAST(user_id AS VARCHAR) AS user_id FROM impressions""",
)
def select_spec(spark, sf):
    return P.select_spec(impressions(spark, sf), SPEC.choose(["label_convert"], "v1"))


@query(
    "filter_scope",
    f"""WITH {IMPRESSIONS} SELECT dt, user_id, item_id, tag, source FROM impressions
    WHERE dt >= '19950101' AND dt <= '19961231' AND tag = 'R' AND source IN ('1-URGENT', '2-HIGH', '5-LOW')""",
)
def filter_scope(spark, sf):
    rows = impressions(spark, sf, "19950101", "19961231").select("dt", "user_id", "item_id", "tag", "source")
    return P.filter_scope(
        rows, "19950101", "19961231", {"tag": "R"}, {"source": ["1-URGENT", "2-HIGH", "5-LOW"]}
    )


@query(
    "cast_spec",
    f"""WITH {IMPRESSIONS} SELECT order_id, line_no, CAST(trunc(duration) AS INT) AS duration, CAST(amount AS FLOAT) AS amount,
    CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS INT) AS tag, CAST(dt AS INT) AS dt,
    CAST(floor(pred * 100) AS BIGINT) AS m FROM impressions""",
)
def cast_spec(spark, sf):
    rows = impressions(spark, sf).select(
        "order_id", "line_no", "duration", "amount", "user_id", "tag", "dt",
        F.array(F.floor(F.col("pred") * 100)).alias("vec"),
        F.create_map(F.lit("p"), F.floor(F.col("pred") * 100)).alias("m"),
    )
    types = {"duration": "int32", "amount": "float32", "user_id": "string", "tag": "Int", "dt": "int",
             "vec": "IntVec", "m": "MapStringFloat32"}
    out = P.cast_spec(rows, types)
    same = F.col("m")["p"].cast("long") == F.get("vec", F.lit(0))
    return out.withColumn("m", F.when(same, F.col("m")["p"].cast("long"))).drop("vec")


GAPS = "CASE WHEN event_type <> 'error' THEN value END"


@query(
    "fill_default",
    f"""WITH {BEHAVIOUR} SELECT event_id, coalesce({GAPS}, -1.0) AS value,
    coalesce(CASE WHEN event_type <> 'signup' THEN event_type END, '') AS event_type,
    CASE WHEN item_id < 50 THEN item_id || ',7' ELSE '0,0' END AS pair,
    CASE WHEN item_id < 20 THEN item_id END AS mapped FROM behaviour""",
)
def fill_default(spark, sf):
    rows = behaviour(spark, sf).select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("event_type"),
        F.when(F.col("item_id") < 50, F.array("item_id", F.lit(7))).alias("pair"),
        F.when(F.col("item_id") < 20, F.create_map(F.lit("k"), "item_id")).alias("mapped"),
    )
    out = P.fill_default(rows, {"value": -1.0, "event_type": "", "pair": [0, 0], "mapped": {}})
    return out.withColumns({"pair": ids("pair"), "mapped": F.col("mapped")["k"]})


TYPES5 = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"


@query(
    "apply_spec",
    """WITH s AS (SELECT round(avg(p_retailprice), 6) AS m, round(stddev_samp(p_retailprice), 6) AS sd,
      round(avg(ln(p_size)), 6) AS lm, round(stddev_samp(ln(p_size)), 6) AS ls FROM part WHERE p_size <> 0),
    b AS (SELECT p_brand AS value, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS idx FROM part GROUP BY 1 HAVING count(*) >= 2),
    w AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS idx
      FROM (SELECT unnest(string_split(p_name, ' ')[1:3]) AS word FROM part) WHERE word <> '' GROUP BY 1),
    n AS (SELECT p_partkey, list(coalesce(w.idx, 0) ORDER BY pos) AS l FROM
      (SELECT p_partkey, unnest(string_split(p_name, ' ')[1:3]) AS word, generate_subscripts(string_split(p_name, ' ')[1:3], 1) AS pos FROM part)
      LEFT JOIN w USING (word) GROUP BY 1)
    SELECT p_partkey, round((p_retailprice - m) / sd, 6) AS p_retailprice, round((ln(p_size + 1) - lm) / ls, 6) AS p_size,
      CAST(coalesce(b.idx, 0) AS INT) AS p_brand,
      CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 0 END AS p_type,
      array_to_string(list_resize(l, 3, 0), ',') AS p_name,
      p_size || '000000,' || (p_size + 1) || '000000' AS pair_text
    FROM part CROSS JOIN s LEFT JOIN b ON p_brand = b.value JOIN n USING (p_partkey)""",
)
def apply_spec(spark, sf):
    rows = table(spark, sf, "part").withColumn("pair_text", F.concat_ws(",", "p_size", F.col("p_size") + 1))
    fields = [
        DenseField("p_retailprice", op="normal", default=-1.0),
        DenseField("p_size", op="log_normal", default=0.0),
        CategoryField("p_brand", min_cnt=2),
        CategoryField("p_type", vocab=("ECONOMY", "PROMO")),
        TokensField("p_name", sep=" ", max_len=3),
        VectorField("pair_text", dim=2),
    ]
    vocab, stats = fit.fit_all(rows, fields)
    out = A.apply_spec(rows, fit.with_parameters(fields, stats), vocab, keep=["p_partkey"], key=["p_partkey"])
    return out.withColumns(
        {
            "p_retailprice": F.round("p_retailprice", 6),
            "p_size": F.round("p_size", 6),
            "p_name": ids("p_name"),
            "pair_text": fixed("pair_text"),
        }
    )


GIVEN_12 = ["red", "blue", "", "plate", "ring", "rod", "widget", "cold", "hot", "new", "old", "gear"]
GIVEN_82 = [*GIVEN_12, *(f"word{i}" for i in range(70))]


def _given_sql(words, pad):
    found = f"list_transform(w, lambda x: coalesce(list_position({words}, x), 0))"
    return f"array_to_string(list_resize({found}, 3, {pad}), ',')"


@query(
    "apply_given",
    f"""WITH {IMPRESSIONS}, t AS (SELECT order_id, line_no, source, string_split(coalesce(CASE WHEN p_size % 10 <> 0 THEN p_name END, ''), ' ')[1:3] AS w
      FROM impressions JOIN part ON p_partkey = item_id)
    SELECT order_id, line_no, CAST(CASE WHEN source = '1-URGENT' THEN 100 ELSE 0 END AS INT) AS source, {_given_sql(GIVEN_12, 0)} AS few,
    {_given_sql(GIVEN_82, 0)} AS many, {_given_sql(GIVEN_12, 3)} AS few_first, {_given_sql(GIVEN_82, 3)} AS many_first FROM t""",
)
def apply_given(spark, sf):
    """Given vocabularies of 12 and 82 words over rows that share keys, with null texts and unknown words."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("name"))
    rows = impressions(spark, sf).join(parts, "item_id").select("order_id", "line_no", "source", "name")
    names = {"few": (GIVEN_12, False), "many": (GIVEN_82, False), "few_first": (GIVEN_12, True), "many_first": (GIVEN_82, True)}
    fields = [TokensField(n, sep=" ", max_len=3, vocab=words, pad_first=first) for n, (words, first) in names.items()]
    fields.append(CategoryField("source", vocab=[*(f"kind{i}" for i in range(99)), "1-URGENT"]))
    out = A.apply_spec(rows.withColumns({n: F.col("name") for n in names}), fields, keep=["order_id", "line_no"], key=["order_id", "line_no"])
    return out.withColumns({n: ids(n) for n in names})


@query(
    "label_threshold",
    f"WITH {IMPRESSIONS} SELECT order_id, line_no, item_id, duration, CAST(duration >= 30 AS INT)::FLOAT AS has_convert FROM impressions",
)
def label_threshold(spark, sf):
    rows = impressions(spark, sf).select("order_id", "line_no", "item_id", "duration")
    return P.label_threshold(rows, "duration", 30, "has_convert")


@query(
    "multi_label_split",
    f"""WITH {IMPRESSIONS} SELECT user_id AS features_user_id, item_id AS features_item_id, amount AS features_amount,
    label_enter AS label_label_enter, label_convert AS label_label_convert FROM impressions""",
)
def multi_label_split(spark, sf):
    rows = impressions(spark, sf).select("user_id", "item_id", "amount", "label_enter", "label_convert")
    return P.flatten_struct(P.split_labels(rows, ["label_enter", "label_convert"]))


@query(
    "flatten_struct",
    f"""WITH {IMPRESSIONS} SELECT dt, user_id AS user_id, item_id AS show_item_id, owner_id AS show_owner_id,
    amount AS show_price_amount, tax AS show_price_tax FROM impressions""",
)
def flatten_struct(spark, sf):
    rows = impressions(spark, sf).select(
        "dt",
        F.struct(F.col("user_id").alias("id")).alias("user"),
        F.struct("item_id", "owner_id", F.struct("amount", "tax").alias("price")).alias("show"),
    )
    return P.flatten_struct(rows)


@query(
    "flatten_array",
    """SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\n]'), lambda x: true)) AS INT) AS n_words,
    md5(array_to_string(string_split_regex(text, '[ \\n]'), '|')) AS words FROM documents""",
)
def flatten_array(spark, sf):
    nested = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    rows = table(spark, sf, "documents").select("doc_id", F.transform(nested, lambda x: F.array(x)).alias("words"))
    out = P.flatten_array(rows, "words")
    return out.select("doc_id", F.size("words").alias("n_words"), F.md5(F.array_join("words", "|")).alias("words"))


@query(
    "validate_data",
    f"""WITH {IMPRESSIONS}, {BEHAVIOUR}, x AS (SELECT CAST(item_id AS INT) AS item_id,
      CASE WHEN event_type <> 'error' THEN event_type END AS event_type, CAST(value AS VARCHAR) AS value FROM behaviour)
    SELECT 'item_id' AS "column", count(*) AS n_rows, count(*) FILTER (item_id IS NULL) AS n_null, CAST(0 AS BIGINT) AS n_bad,
      count(*) FILTER (item_id = 0) AS n_default FROM x
    UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL), count(event_type), CAST(0 AS BIGINT) FROM x
    UNION ALL SELECT 'value', count(*), count(*) FILTER (value IS NULL), CAST(0 AS BIGINT), count(*) FILTER (CAST(value AS FLOAT) = 0) FROM x""",
)
def validate_data(spark, sf):
    rows = behaviour(spark, sf).select(
        "item_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
        F.col("value").cast("string").alias("value"),
    )
    return P.validate_data(
        rows, {"item_id": "Int", "event_type": "Int", "value": "Float32"}, {"item_id": 0, "event_type": 0, "value": 0.0}
    )


# --- expressions ---
def _expr(name, sql, columns):
    """Register a query over the behaviour table: ``columns`` maps names to Columns."""

    @query(name, f"WITH {BEHAVIOUR} SELECT event_id, {sql} FROM behaviour")
    def run(spark, sf):
        return behaviour(spark, sf).select("event_id", *[c.alias(n) for n, c in columns().items()])


_expr("expr_identity", "value AS v, event_type AS t", lambda: {"v": X.identity("value"), "t": X.identity("event_type")})
_expr(
    "expr_map_values",
    "CASE WHEN event_type='view' THEN item_id || ',0,0' WHEN event_type='click' THEN '0,' || item_id || ',0' ELSE '0,0,0' END AS v",
    lambda: {
        "v": ids(
            X.get_map_values(
                F.create_map(F.col("event_type"), F.col("item_id").cast("float")), ["view", "click", "absent"]
            ).cast("array<int>")
        )
    },
)
_expr(
    "expr_map_value",
    "CASE WHEN item_id = 7 THEN CAST(value AS FLOAT) ELSE 0::FLOAT END AS v",
    lambda: {"v": X.map_value(F.create_map(F.col("item_id"), F.col("value")), 7)},
)
_expr(
    "expr_concat_ws",
    "event_type || ',' || item_id || ',' || dt AS v",
    lambda: {"v": X.concat_ws(F.array("event_type", F.col("item_id").cast("string"), "dt"), ",")},
)
_expr("expr_hour", "CAST(hour(ts) AS INT) AS e_hour", lambda: {"e_hour": X.hour("ts")})
_expr("expr_weekday", "CAST(isodow(ts) - 1 AS INT) AS e_weekday", lambda: {"e_weekday": X.weekday("ts")})
_expr("expr_batch_const", "60 AS quickmatch, 'd' AS unit", lambda: {"quickmatch": X.batch_const(60), "unit": X.batch_const("d")})
_expr(
    "expr_if_equal",
    "CASE WHEN event_type = 'view' THEN item_id ELSE -1 END AS v",
    lambda: {"v": X.if_equal("event_type", "view", F.col("item_id"), -1)},
)
_expr(
    "expr_time_cnt",
    """CASE WHEN event_type = 'error' THEN 0 ELSE CAST(DATE '2024-02-15' - CAST(ts AS DATE) AS INT) END AS days""",
    lambda: {
        "days": X.time_count(F.lit("2024-02-15").cast("timestamp_ntz"), F.when(F.col("event_type") != "error", F.col("ts")))
    },
)
_expr(
    "expr_elapsed_now",
    "epoch_us(TIMESTAMP '2024-02-15')//1000000 - sec AS seconds",
    lambda: {"seconds": X.elapsed_seconds(F.lit("2024-02-15").cast("timestamp_ntz"), "ts")},
)
_expr("expr_str", "CAST(user_id AS VARCHAR) AS user_id", lambda: {"user_id": X.as_string("user_id")})
_expr(
    "expr_last_segment",
    "split_part(event_type || '.' || CAST(item_id AS VARCHAR), '.', -1) AS v, event_type AS w",
    lambda: {
        "v": X.last_segment(F.concat_ws(".", "event_type", F.col("item_id").cast("string"))),
        "w": X.last_segment("event_type"),
    },
)


@query(
    "expr_same",
    """SELECT o_orderkey, l_partkey, l_linenumber, CAST(c_nationkey = s_nationkey AS INT) AS is_same_nation
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
)
def expr_same(spark, sf):
    t = lambda n: table(spark, sf, n)
    rows = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return rows.select("o_orderkey", "l_partkey", "l_linenumber", X.same("c_nationkey", "s_nationkey").alias("is_same_nation"))


_expr("expr_abs_diff", "abs(item_id - CAST(user_id AS INT)) AS diff", lambda: {"diff": X.abs_diff("item_id", F.col("user_id").cast("int"))})


@query(
    "hook_transform",
    """SELECT p_partkey, round(sqrt(p_retailprice) / 2, 6) AS p_retailprice, p_size % 10 AS p_size FROM part""",
)
def hook_transform(spark, sf):
    """Features made by functions of the specification."""
    fields = [
        DenseField("p_retailprice", transform=lambda c: F.sqrt(c) / 2),
        DenseField("p_size", transform=lambda c: c % 10),
    ]
    out = A.apply_spec(table(spark, sf, "part"), fields, keep=["p_partkey"])
    return out.withColumn("p_retailprice", F.round("p_retailprice", 6))


@query(
    "hook_before_vocab",
    f"""WITH {BEHAVIOUR}, t AS (SELECT event_id, CAST(item_id % 17 AS VARCHAR) AS v FROM behaviour),
    vocab AS (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS idx FROM t WHERE v IS NOT NULL AND v <> '3' GROUP BY 1)
    SELECT event_id, CAST(coalesce(idx, 0) AS INT) AS path FROM t LEFT JOIN vocab USING (v)""",
)
def hook_before_vocab(spark, sf):
    """A named clean-up before fitting and before the lookup: the last part of a dotted path."""
    path = F.concat_ws(".", "event_type", (F.col("item_id") % 17).cast("string"))
    rows = behaviour(spark, sf).select("event_id", F.when(F.col("item_id").isNotNull(), path).alias("path"))
    fields = [CategoryField("path", default="3", before_vocab="split_dot_get_last")]
    return A.apply_spec(rows, fields, fit.fit_vocab(rows, fields), keep=["event_id"], key=["event_id"])


@query(
    "prepare_training",
    f"""WITH {IMPRESSIONS} SELECT order_id, line_no, item_id, CAST(user_id AS VARCHAR) AS user_id, CAST(trunc(duration) AS INT) AS duration,
    CAST(coalesce(c_nationkey, -1) AS INT) AS nation, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, 'none') AS segment,
    label_enter, CAST(duration >= 20 AS INT) AS label_long
    FROM impressions LEFT JOIN customer ON user_id = c_custkey WHERE dt BETWEEN '19950101' AND '19950630'""",
)
def prepare_training(spark, sf):
    """The preparation job of one period: profile join, types, defaults and the user's own step."""
    rows = impressions(spark, sf, "19950101", "19950630").select(
        "order_id", "line_no", "item_id", "user_id", "duration", "label_enter"
    )
    profile = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("segment"),
    )
    return P.build_training_table(
        rows,
        {"user_id": "string", "duration": "int32", "nation": "int32", "segment": "string"},
        {"nation": -1, "segment": "none"},
        lambda df: df.withColumn("label_long", (F.col("duration") >= 20).cast("int")),
        profile,
        ["user_id"],
    )
