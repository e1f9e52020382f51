"""Document queries: shingles, min-hash, near-copy groups, k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import normalise
from lakeloom.operators import documents as D
from lakeloom.session import cut, table

#: At a similarity of 0.5, 24 bands of 2 miss a pair once in a thousand times.
WIDTH, CHARS, HASHES, BANDS, THRESHOLD, CENTRES = 3, 5, 48, 24, 0.5, 5


def doc_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", normalise("text").alias("plain"))


def doc_shingles(spark, d):
    return D.shingles(table(spark, d, "documents"), WIDTH)


def doc_char_shingles(spark, d):
    """A digest of each document's sorted shingles."""
    return D.shingle_digests(table(spark, d, "documents"), CHARS)


def _signatures(spark, d):
    return D.minhash(table(spark, d, "documents"), HASHES, WIDTH)


def doc_minhash(spark, d):
    return _signatures(spark, d).select("doc", F.array_join("signature", ",").alias("signature"))


def doc_candidates(spark, d):
    return D.candidates(cut(_signatures(spark, d)), BANDS, HASHES // BANDS)


def doc_sig_similarity(spark, d):
    pairs = D.matches(cut(_signatures(spark, d)), BANDS, HASHES // BANDS)
    return pairs.select("a", "b", F.round(F.col("same") / HASHES, 8).alias("estimate"))


def _verified(spark, d):
    rows = table(spark, d, "documents")
    pairs = D.candidates(cut(D.minhash(rows, HASHES, WIDTH, sketch=True)), BANDS, HASHES // BANDS, THRESHOLD)
    return D.verify(pairs, D.shingle_sets(rows, WIDTH), THRESHOLD)


def doc_verify(spark, d):
    return _verified(spark, d).select("a", "b", F.round("jaccard", 8).alias("jaccard"))


def doc_groups(spark, d):
    return D.groups(_verified(spark, d))


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _centres(spark, d):
    return _points(spark, d).where(F.col("id") < CENTRES).select(F.col("id").cast("int").alias("centre"), F.col("v").alias("c"))


def km_assign(spark, d):
    return D.assign(_points(spark, d), _centres(spark, d)).select("id", "centre", F.round("distance2", 6).alias("distance2"))


def km_inertia(spark, d):
    return D.inertia(D.assign(_points(spark, d), _centres(spark, d))).select("n", F.round("inertia", 4).alias("inertia"))


def km_silhouette(spark, d):
    return D.silhouette(_points(spark, d), D.assign(_points(spark, d), _centres(spark, d))).select("n", F.round("silhouette", 8).alias("silhouette"))


def km_purity(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return D.purity(D.assign(_points(spark, d), _centres(spark, d)), labels).select("n", F.round("purity", 8).alias("purity"))


def km_fit(spark, d):
    points = _points(spark, d)
    return D.assign(points, D.centres_of(D.kmeans(points, 10), spark))


def km_documents(spark, d):
    """Min-hash signatures as one-hot pairs, then k-means: clusters of documents."""
    from pyspark.ml.clustering import KMeans

    vectors = D.signature_vectors(cut(_signatures(spark, d)))  # read by the fit and again for the result
    return KMeans(k=8, seed=42, maxIter=10, featuresCol="features", predictionCol="cluster").fit(vectors).transform(vectors).select("doc", "cluster")


_W = r"""plain as (select doc_id as doc, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as plain from documents where text is not null),
words as (select doc, string_split(plain, ' ') as w from plain where plain <> ''),
sh as materialized (select distinct doc, array_to_string(list_slice(w, i, i + 2), ' ') as shingle from (select doc, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from words))"""
_SIG = _W + ", num as materialized (select doc, cast('0x' || substr(md5(shingle), 1, 8) as bigint) % 2147483647 as x from sh), sig as materialized (select doc, " + ", ".join(f"min((x * {a} + {b}) % 2147483647) as m{i}" for i, (a, b) in enumerate(D.hash_parameters(HASHES))) + " from num group by doc)"
_ALLM = ", ".join(f"m{i}" for i in range(HASHES))
_CAND = _SIG + f""", same as (select {_ALLM}, min(doc) as doc from sig group by {_ALLM}),
cand as materialized (
  select a, b from (select min(doc) over (partition by {_ALLM}) as a, doc as b from sig) where a <> b
  union {" union ".join(f"select x.doc as a, y.doc as b from same x join same y on x.m{2 * i} = y.m{2 * i} and x.m{2 * i + 1} = y.m{2 * i + 1} and x.doc < y.doc" for i in range(BANDS))}
)"""
_VER = _CAND + """, size as (select doc, count(*) as n from sh group by doc),
ver as materialized (
  select a, b, shared / cast(x.n + y.n - shared as double) as jaccard from (
    select c.a, c.b, count(*) as shared from cand c join sh s on c.a = s.doc join sh t on c.b = t.doc and s.shingle = t.shingle group by 1, 2
  ) join size x on a = x.doc join size y on b = y.doc where shared / cast(x.n + y.n - shared as double) >= 0.5
)"""
_KM = """p as (select vec_id as id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
d as (select p.id, p.label, c.id as centre, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance2 from p cross join (select * from p where id < 5) c),
near as (select id, label, cast(centre as integer) as centre, distance2 from (select *, row_number() over (partition by id order by distance2, centre) as r from d) where r = 1)"""

QUERIES = {f.__name__: f for f in (doc_normalise, doc_shingles, doc_char_shingles, doc_minhash, doc_candidates, doc_sig_similarity, doc_verify, doc_groups, km_assign, km_inertia, km_silhouette, km_purity, km_fit, km_documents)}
ORACLES = {
    "doc_normalise": r"select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as plain from documents",
    "doc_shingles": f"with {_W} select doc, shingle from sh",
    "doc_char_shingles": r"""with plain as (select doc_id as doc, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as plain from documents where text is not null),
sh as (select distinct doc, substr(plain, i, 5) as shingle from (select doc, plain, unnest(range(1, greatest(length(plain) - 4, 1) + 1)) as i from plain where plain <> ''))
select doc, count(*) as n, md5(string_agg(shingle, '|' order by shingle)) as shingles from sh group by doc""",
    "doc_minhash": f"with {_SIG} select doc, concat_ws(',', {_ALLM}) as signature from sig",
    "doc_candidates": f"with {_CAND} select a, b from cand",
    "doc_sig_similarity": f"with {_CAND} select a, b, round(({' + '.join(f'cast(x.m{i} = y.m{i} as integer)' for i in range(HASHES))}) / cast({HASHES} as double), 8) as estimate from cand join sig x on a = x.doc join sig y on b = y.doc",
    "doc_verify": f"with {_VER} select a, b, round(jaccard, 8) as jaccard from ver",
    "doc_groups": f"""with recursive {_VER}, link as materialized (select a, b from ver union select b, a from ver),
reach(node, root) as (select distinct a, a from link union select l.b, r.root from reach r join link l on r.node = l.a where r.root < l.b)
select node as doc, min(root) as "group" from reach group by node""",
    "km_assign": f"with {_KM} select id, centre, round(distance2, 6) as distance2 from near",
    "km_inertia": f"with {_KM} select count(*) as n, round(sum(distance2), 4) as inertia from near",
    "km_silhouette": f"""with {_KM}, pair as (
  select a.id, a.centre as own, b.centre, sum(list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as total, count(*) as size
  from near a join p on p.id = a.id cross join near b join p q on q.id = b.id group by all
), s as (
  select id, max(case when centre = own then size end) as size, max(case when centre = own and size > 1 then total / (size - 1) end) as a, min(case when centre <> own then total / size end) as b from pair group by id
)
select count(*) as n, round(avg(case when b is null then null when size = 1 or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 8) as silhouette from s""",
    "km_purity": f"""with {_KM}, c as (select centre, label, count(*) as n from near group by 1, 2), b as (select centre, max(n) as best, sum(n) as n from c group by 1)
select cast(sum(n) as bigint) as n, round(sum(best) / sum(n), 8) as purity from b""",
}
