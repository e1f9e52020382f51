"""Recommendation queries: customers are users, parts are items, quantities ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import recommend as R
from lakeloom.session import cut, table

SUPPORT, K, N, CAP = 3, 5, 10, 20


def _x(spark: SparkSession, d: str, last: bool = False) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return R.interactions(rows, "o_custkey", "l_partkey", "l_quantity", **({"how": "last", "order": "o_orderdate"} if last else {}))


def _round(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def cf_interactions(spark, d):
    return _x(spark, d)


def cf_interactions_last(spark, d):
    return _x(spark, d, last=True)


def cf_cap(spark, d):
    return R.cap_per_user(_x(spark, d), CAP)


def cf_cooccur(spark, d):
    return R.cooccur(_x(spark, d), SUPPORT)


def cf_cosine(spark, d):
    return _round(R.similarity(_x(spark, d), "cosine", SUPPORT), "similarity")


def cf_jaccard(spark, d):
    return _round(R.similarity(_x(spark, d), "jaccard", SUPPORT), "similarity")


def cf_pearson(spark, d):
    return _round(R.similarity(_x(spark, d), "pearson", SUPPORT), "similarity")


def cf_adjusted_cosine(spark, d):
    return _round(R.similarity(_x(spark, d), "adjusted_cosine", SUPPORT), "similarity", digits=7)


def _near(x: DataFrame) -> DataFrame:
    return R.neighbours(_round(R.similarity(x, "cosine", SUPPORT), "similarity"), K)


def _nb(spark, d):
    return _near(_x(spark, d))


def cf_cosine_topk(spark, d):
    return _nb(spark, d)


def cf_predict(spark, d):
    return _round(R.predict(_x(spark, d), _nb(spark, d)), "prediction", digits=6)


def cf_recommend(spark, d):
    with R.kept(_x(spark, d)) as x:  # the result is a few rows a user
        return cut(_round(R.recommend(x, _near(x), N), "prediction", digits=6))


def _split(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    test = (F.col("user") + F.col("item")) % 5 == 0
    return x.where(~test), x.where(test)


def cf_rmse(spark, d):
    with R.kept(_x(spark, d)) as x:
        train, test = _split(x)
        return cut(_round(R.rmse(R.predict(train, _near(train)), test), "rmse", digits=6))


def cf_precision_recall(spark, d):
    with R.kept(_x(spark, d)) as x:
        train, test = _split(x)
        ranked = R.recommend(train, _near(train), N)
        return cut(_round(R.precision_recall(ranked, test, N), "precision", "recall"))


def cf_pairs(spark, d):
    """Similar items as printed pairs, both ways."""
    return _nb(spark, d).select(F.format_string("('%s', '%s')", F.col("item").cast("string"), F.col("neighbour").cast("string")).alias("pair"))


_X = """x as materialized (
  select o_custkey as "user", l_partkey as item, sum(l_quantity) as rating from orders join lineitem on o_orderkey = l_orderkey group by 1, 2
)"""
_COSINE = """norms as (select item, sqrt(sum(rating * rating)) as norm from {x} group by item),
scaled as (select x."user", x.item, x.rating / n.norm as rating from {x} x join norms n on x.item = n.item where n.norm > 0),
sim as materialized (
  select a.item as i, b.item as j, count(*) as support, round(sum(a.rating * b.rating), 8) as similarity
  from scaled a join scaled b on a."user" = b."user" and a.item < b.item group by 1, 2 having count(*) >= 3
)"""
_NB = """nb as materialized (
  select * from (
    select item, neighbour, similarity, cast(row_number() over (partition by item order by similarity desc, neighbour) as integer) as rank
    from (select i as item, j as neighbour, similarity from sim union all select j, i, similarity from sim)
  ) where rank <= 5
)"""
_TOP = f"with {_X}, {_COSINE.format(x='x')}, {_NB} "
_PREDICT = """predicted as materialized (
  select s."user", nb.item, case when sum(abs(nb.similarity)) > 0 then sum(nb.similarity * s.rating) / sum(abs(nb.similarity)) end as prediction
  from {x} s join nb on s.item = nb.neighbour group by 1, 2
)"""
_SPLIT = """train as materialized (select * from x where ("user" + item) % 5 <> 0), test as materialized (select * from x where ("user" + item) % 5 = 0)"""

QUERIES = {f.__name__: f for f in (cf_interactions, cf_interactions_last, cf_cap, cf_cooccur, cf_cosine, cf_jaccard, cf_pearson, cf_adjusted_cosine, cf_cosine_topk, cf_predict, cf_recommend, cf_rmse, cf_precision_recall, cf_pairs)}
ORACLES = {
    "cf_interactions": f"with {_X} select * from x",
    "cf_interactions_last": """select "user", item, rating from (
  select o_custkey as "user", l_partkey as item, l_quantity as rating, row_number() over (partition by o_custkey, l_partkey order by o_orderdate desc, l_quantity desc) as r
  from orders join lineitem on o_orderkey = l_orderkey) where r = 1""",
    "cf_cap": f'with {_X} select "user", item, rating from (select *, row_number() over (partition by "user" order by item) as r from x) where r <= 20',
    "cf_cooccur": f'with {_X} select a.item as i, b.item as j, count(*) as support from x a join x b on a."user" = b."user" and a.item < b.item group by 1, 2 having count(*) >= 3',
    "cf_cosine": f"with {_X}, {_COSINE.format(x='x')} select * from sim",
    "cf_jaccard": f"""with {_X}, n as (select item, count(*) as n from x group by item),
c as (select a.item as i, b.item as j, count(*) as support from x a join x b on a."user" = b."user" and a.item < b.item group by 1, 2 having count(*) >= 3)
select i, j, support, round(support / cast(a.n + b.n - support as double), 8) as similarity from c join n a on c.i = a.item join n b on c.j = b.item""",
    "cf_pearson": f"""with {_X}, s as (
  select a.item as i, b.item as j, count(*) as support, sum(a.rating) as sa, sum(b.rating) as sb, sum(a.rating * a.rating) as saa, sum(b.rating * b.rating) as sbb, sum(a.rating * b.rating) as sab
  from x a join x b on a."user" = b."user" and a.item < b.item group by 1, 2 having count(*) >= 3)
select i, j, support, round((support * sab - sa * sb) / sqrt((support * saa - sa * sa) * (support * sbb - sb * sb)), 8) as similarity
from s where support * saa - sa * sa > 0 and support * sbb - sb * sb > 0""",
    "cf_adjusted_cosine": f"""with {_X}, c as materialized (select "user", item, rating - avg(rating) over (partition by "user") as rating from x), {_COSINE.format(x='c').replace(', 8)', ', 7)')} select * from sim""",
    "cf_cosine_topk": _TOP + "select item, neighbour, similarity, rank from nb",
    "cf_predict": _TOP + f', {_PREDICT.format(x="x")} select "user", item, round(prediction, 6) as prediction from predicted',
    "cf_recommend": _TOP
    + f""", {_PREDICT.format(x="x")}, ranked as (
  select p.*, cast(row_number() over (partition by p."user" order by round(prediction, 8) desc, p.item) as integer) as rank from predicted p
  where prediction is not null and not exists (select 1 from x where x."user" = p."user" and x.item = p.item))
select "user", item, round(prediction, 6) as prediction, rank from ranked where rank <= 10""",
    "cf_rmse": f"""with {_X}, {_SPLIT}, {_COSINE.format(x='train')}, {_NB}, {_PREDICT.format(x='train')}
select count(*) as n, round(sqrt(avg((p.prediction - t.rating) * (p.prediction - t.rating))), 6) as rmse from test t join predicted p on t."user" = p."user" and t.item = p.item where p.prediction is not null""",
    "cf_precision_recall": f"""with {_X}, {_SPLIT}, {_COSINE.format(x='train')}, {_NB}, {_PREDICT.format(x='train')}, ranked as (
  select p.*, row_number() over (partition by p."user" order by round(prediction, 8) desc, p.item) as r from predicted p
  where prediction is not null and not exists (select 1 from train x where x."user" = p."user" and x.item = p.item)),
hits as (select r."user", count(*) as hits from ranked r join test t on r."user" = t."user" and r.item = t.item where r.r <= 10 group by 1),
own as (select "user", count(*) as own from test group by 1)
select count(*) as users, round(avg(coalesce(hits, 0) / cast(10 as double)), 8) as precision, round(avg(coalesce(hits, 0) / cast(own as double)), 8) as recall from own left join hits on own."user" = hits."user" """,
    "cf_pairs": _TOP + "select '(''' || item || ''', ''' || neighbour || ''')' as pair from nb",
}
