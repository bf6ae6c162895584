"""Registered queries: vector codes and inverted-list search.

Checked queries use the mean vector of each label as centers and code book, which one
aggregation over the whole table gives in both engines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import scale
from tessera.functions.vectorstats import mean_vector
from tessera.operators import approx as A
from tessera.operators import ivf
from tessera.operators import quality as Q
from tessera.operators import quantize as C
from tessera.operators import search as S
from tessera.plans.registry import kept, query
from tessera.plans.vectors import QSET, q0, qset
from tessera.session import work_path

E = """e as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as pos,
    unnest(embedding)::double as x from {embeddings})"""
LEVELS = E + """, st as (select pos, min(x) as lo, (max(x) - min(x)) / 255.0::double as step from e group by pos),
  sqc as (select vec_id, pos, lo, step, round_even((x - lo) / step, 0) as code from e join st using (pos)),
  sqd as (select vec_id as id, list(lo + code * step order by pos) as dv from sqc group by vec_id)"""
CENT = E + """, cl as (select label as list_id, pos, avg(x) as c from e group by all),
  cent as (select list_id, list(c order by pos) as cv from cl group by list_id)"""
PQ = CENT + """, pqs as (select vec_id, pos // 8 as m, list_id as code, sum((x - c) * (x - c)) as d
    from e join cl using (pos) group by all),
  pqc as (select vec_id, m, code from (select *, row_number() over
    (partition by vec_id, m order by d, code) as rn from pqs) where rn = 1),
  pqd as (select vec_id as id, list(c order by pos) as dv from pqc join cl
    on code = list_id and pos // 8 = m group by vec_id)"""
ASG = """asg as (select id, list_id, v from (select vec_id as id, embedding::double[] as v, list_id,
    row_number() over (partition by vec_id order by list_distance(embedding::double[], cv), list_id) as rn
    from {embeddings}, cent) where rn = 1)"""


def prb(n: int) -> str:
    return QSET + f""", prb as (select * from (select qid, qv, list_id, list_distance(qv, cv) as dist,
      row_number() over (partition by qid order by list_distance(qv, cv), list_id) as rank
      from qset, cent) where rank <= {n})"""


def found(dist: str, k: int, extra: str = "") -> str:
    return f"""fnd as (select qid, id, dist, row_number() over (partition by qid order by dist, id) as rank
      from (select qid, asg.id as id, {dist} as dist from prb join asg using (list_id) {extra})
      qualify rank <= {k})"""


HITS = "select qid, id, round(dist, 6) as dist, rank::int as rank from fnd"


def lloyd_sql(parts: int, k: int, rounds: int, tag: str = "", rows: str = "e") -> str:
    """CTEs of k-means in sub-spaces from the seeded sample: last one ``c<rounds>``."""
    width = 64 // parts
    out = [f"""sd{tag} as (select vec_id, row_number() over (order by md5(concat('42:', cast(vec_id as string))), vec_id) - 1 as code
      from {{embeddings}} qualify code < {k}),
    c0{tag} as materialized (select pos // {width} as part, code, pos, x as c from {rows} join sd{tag} using (vec_id))"""]
    for r in range(1, rounds + 1):
        out.append(f"""a{r}{tag} as materialized (select vec_id, part, code from (select vec_id, part, code, sum((x - c) * (x - c)) as d
        from {rows} join c{r - 1}{tag} using (pos) group by all)
      qualify row_number() over (partition by vec_id, part order by d, code) = 1),
    c{r}{tag} as materialized (select part, code, pos, avg(x) as c from a{r}{tag} join {rows} using (vec_id)
      where pos // {width} = part group by all)""")
    return ", ".join(out)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def centers(t):
    """One mean vector per label, computed once and kept as a local table (ten rows)."""
    if "_centers" not in vars(t):
        means = mean_vector(t.embeddings, "label").withColumnRenamed("label", "list_id")
        t._centers = scale.local_table(means)
    return t._centers


def center_matrix(t) -> np.ndarray:
    return np.array([r["center"] for r in sorted(centers(t).collect(), key=lambda r: r["list_id"])])


def book(t) -> C.ProductCodec:
    """Eight sub-spaces with the ten label means as code words."""
    m = center_matrix(t)
    return C.ProductCodec(m.reshape(len(m), 8, -1).transpose(1, 0, 2))


def lists(t):
    return ivf.assign(t.user_vectors, centers(t))


def stored(t, form: str = "flat"):
    """The index of a table in one of its forms, written once per state of its files and read by every search."""

    def make() -> str:
        if form == "flat":
            rows = lists(t)
        else:
            flat = stored(t)
            if form == "bits":
                rows = ivf.encode_bits(flat, center_matrix(t))
            else:
                rows = flat.select("list_id", "id", codec_of(t, form).encode("embedding").alias("codes"))
        path = work_path(t.spark, f"index-{form}")
        ivf.write_index(rows, path)
        return path

    return t.spark.read.parquet(kept(t, f"index-{form}", make))


def codec_of(t, form: str):
    """The codec of a stored form; its parameters are trained once per state of the table's files."""
    if form == "pq":
        return book(t)
    return kept(t, f"codec-{form}", lambda: C.HalfCodec(64) if form == "fp16" else C.sq_train(t.embeddings, 4 if form == "sq4" else 8))


# ---------------------------------------------------------------- scalar codes


@query("sq_train", f"with {E} select pos::int as pos, min(x) as lo, (max(x) - min(x)) / 255.0::double as step from e group by pos")
def sq_train(t):
    return C.sq_params(t.embeddings)


@query(
    "sq_train_global",
    f"with {E} select min(x) as lo, (max(x) - min(x)) / 255.0::double as step from e",
)
def sq_train_global(t):
    return C.sq_params(t.embeddings, shared=True).select("lo", "step").distinct()


@query("sq_encode", f"with {LEVELS} select vec_id, pos, code::int as code from sqc")
def sq_encode(t):
    codec = C.sq_train(t.embeddings)
    coded = t.embeddings.select("vec_id", codec.encode("embedding").alias("codes"))
    codes = coded.select("vec_id", F.posexplode(codec.unpacked("codes")).alias("pos", "code"))
    return codes.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("int").alias("code"))


@query(
    "sq_decode",
    f"with {LEVELS} select vec_id, pos, round(lo + code * step, 6) + 0.0 as x from sqc".replace("255.0", "15.0"),
)
def sq_decode(t):
    """Four-bit codes and back."""
    codec = C.sq_train(t.embeddings, bits=4)
    back = t.embeddings.select("vec_id", codec.encode("embedding").alias("codes"))
    flat = back.select("vec_id", F.posexplode(codec.decode("codes")).alias("pos", "x"))
    return flat.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


LUT_SQL = """, q as (select embedding::double[] as qv from {embeddings} where vec_id = 0)
    select id, round(pow(list_distance(dv, qv), 2), 6) as dist from SQD, q
    order by list_distance(dv, qv), id limit 20"""


@query("sq_lut_distance", f"with {LEVELS}" + LUT_SQL.replace("SQD", "sqd"))
def sq_lut_distance(t):
    codec = C.sq_train(t.embeddings)
    coded = t.user_vectors.select("id", codec.encode("embedding").alias("codes"))
    return r6(C.adc_search(coded, codec, q0(t), 20), "dist")


@query(
    "quant_error",
    f"""with {LEVELS}, q as (select embedding::double[] as qv from {{embeddings}} where vec_id = 0)
    select round(avg(abs(pow(list_distance(dv, qv), 2) - pow(list_distance(embedding::double[], qv), 2))), 6)
      as mean_abs_error
    from sqd join {{embeddings}} on vec_id = id, q""",
)
def quant_error(t):
    """Mean absolute error of table-lookup distances against exact ones."""
    codec, q = C.sq_train(t.embeddings), q0(t)
    exact = S.METRICS["l2_sq"].to_query("embedding", q)
    approx = C.lut_distance("codes", codec, q)
    coded = t.embeddings.select(exact.alias("exact"), codec.encode("embedding").alias("codes"))
    both = coded.select("exact", approx.alias("approx"))
    return r6(both.agg(F.avg(F.abs(F.expr("exact - approx"))).alias("mean_abs_error")), "mean_abs_error")


@query(
    "sq_kmeans_dim",
    f"with {E}, {lloyd_sql(64, 16, 5)} select pos::int as pos, code::int as code, round(c, 6) + 0.0 as level from c5",
)
def sq_kmeans_dim(t):
    """Levels of a non-uniform scalar codec: one-dimensional k-means per dimension."""
    codec = C.sq_kmeans_train(t.user_vectors, levels=16, rounds=5)
    rows = [(d, j, float(x)) for d, c in enumerate(codec.centers) for j, x in enumerate(c[:, 0])]
    out = t.spark.createDataFrame(rows, "pos int, code int, level double")
    return out.withColumn("level", F.round("level", 6) + 0.0)


# ---------------------------------------------------------------- product codes


@query(
    "pq_train",
    f"""with {E}, {lloyd_sql(8, 16, 5)} select part::int as part, code::int as code, (pos % 8)::int as pos,
      round(c, 6) + 0.0 as x from c5""",
)
def pq_train(t):
    codec = C.pq_train(t.user_vectors, parts=8, bits=4, rounds=5)
    rows = [(m, j, [float(x) for x in c]) for m, cs in enumerate(codec.centers) for j, c in enumerate(cs)]
    out = t.spark.createDataFrame(rows, "part int, code int, center array<double>")
    flat = out.select("part", "code", F.posexplode("center").alias("pos", "x"))
    return flat.withColumn("x", F.round("x", 6) + 0.0)


@query("pq_encode", f"with {PQ} select vec_id, m as part, code from pqc")
def pq_encode(t):
    codec = book(t)
    coded = t.embeddings.select("vec_id", codec.encode("embedding").alias("codes"))
    codes = coded.select("vec_id", F.posexplode(codec.unpacked("codes")).alias("part", "code"))
    return codes.select("vec_id", F.col("part").cast("long").alias("part"), F.col("code").cast("int").alias("code"))


@query(
    "pq_decode",
    f"""with {PQ} select id as vec_id, generate_subscripts(dv, 1) - 1 as pos,
      round(unnest(dv), 6) + 0.0 as x from pqd""",
)
def pq_decode(t):
    codec = book(t)
    coded = t.embeddings.select("vec_id", codec.encode("embedding").alias("codes"))
    flat = coded.select("vec_id", F.posexplode(codec.decode("codes")).alias("pos", "x"))
    return flat.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@query("pq_adc_search", f"with {PQ}" + LUT_SQL.replace("SQD", "pqd").replace(
    "list_distance(dv, qv), id limit", "round(pow(list_distance(dv, qv), 2), 9), id limit"))
def pq_adc_search(t):
    """Vectors with equal codes tie exactly; the lower id comes first."""
    codec = book(t)
    coded = t.user_vectors.select("id", codec.encode("embedding").alias("codes"))
    return r6(C.adc_search(coded, codec, q0(t), 20), "dist")


SWEEP = ((1, 4), (4, 4), (8, 4), (16, 4), (16, 2))


def sweep_sql() -> str:
    """Error of each (parts, bits): squared distance to the nearest center of each part."""
    chains = ", ".join(lloyd_sql(m, 1 << b, 3, f"_{m}_{b}") for m, b in SWEEP)
    one = """select {m} as parts, {b} as bits, round(sum(d) / (count(distinct vec_id) * 64), 6) as mse from
      (select vec_id, part, min(d) as d from (select vec_id, part, code, sum((x - c) * (x - c)) as d
        from e join c3_{m}_{b} using (pos) group by all) group by all)"""
    return f"with {E}, {chains} " + " union all ".join(one.format(m=m, b=b) for m, b in SWEEP)


@query("quant_mse", sweep_sql())
def quant_mse(t):
    """Reconstruction error with fixed bits, and with a fixed number of centers in total; seven
    parts do not divide the dimension and are left out."""
    return r6(C.mse_sweep(t.user_vectors, [*SWEEP, (7, 4)], rounds=3), "mse")


@query("fp16_codes", "select vec_id, 128 as bytes, true as close from {embeddings}")
def fp16_codes(t):
    """Half the bytes; the error stays below the half-precision step of unit vectors."""
    coded = t.embeddings.select("vec_id", "embedding", C.half_codes("embedding").alias("half"))
    back = coded.withColumn("back", C.half_vectors("half"))
    return back.select("vec_id", F.octet_length("half").alias("bytes"),
                       (ivf.pair_distance("embedding", "back") < 0.001).alias("close"))


# ---------------------------------------------------------------- 1-bit codes


# sign flips and Walsh-Hadamard waves for 64 dimensions
TURN = """sg as (select p as pos, case when substr(md5(concat('42:', p)), 1, 1) < '8' then 1 else -1 end as s from range(64) t(p)),
  hd as (select a.pos as i, b.pos as j, s * case when bit_count(a.pos & b.pos) % 2 = 0 then 1 else -1 end / 8.0::double as h
    from sg a, (select pos from sg) b)"""
BITS = E + ", " + TURN + """, m as (select pos, avg(x) as c from e group by pos),
  r as materialized (select vec_id as id, j, sum((x - c) * h) as r from e join m using (pos) join hd on i = e.pos group by all),
  v as (select id, sqrt(sum(r * r)) as norm, sum(abs(r)) / 8 / sqrt(sum(r * r)) as unit from r group by id)"""


def levels_sql(bits: int, over: str = "") -> str:
    """A turned query coordinate ``r`` on uniform levels between its extremes."""
    lo, hi = f"min(r) over ({over})", f"max(r) over ({over})"
    step = f"(greatest({hi} - {lo}, 1e-12::double) / {(1 << bits) - 1})"
    return f"{lo} + round_even((r - {lo}) / {step}, 0) * {step}"


@query(
    "rabitq_encode",
    f"""with {BITS} select id, 8 as bytes, string_agg(case when r >= 0 then '1' else '0' end, '' order by j) as signs,
      round(any_value(norm), 6) as norm, round(any_value(unit), 6) as unit from r join v using (id) group by id""",
)
def rabitq_encode(t):
    """One sign per dimension; the stored norm is the distance to the mean vector."""
    coded = C.bit_encode(t.user_vectors, C.bit_train(t.user_vectors))
    signs = F.lpad(F.conv(F.hex("code.bits"), 16, 2), 64, "0").alias("signs")
    return coded.select("id", F.octet_length("code.bits").alias("bytes"), signs,
                        F.round("code.norm", 6).alias("norm"), F.round("code.unit", 6).alias("unit"))


@query(
    "rabitq_search",
    f"""with {BITS}, q as (select j, r, {levels_sql(4)} as rq from r where id = 0)
    select r.id, round(any_value(norm * norm) + (select sum(r * r) from q)
      - 2 * any_value(norm / unit) * sum(case when r.r >= 0 then rq else -rq end) / 8, 6) as dist
    from r join q using (j) join v on v.id = r.id group by r.id order by dist, r.id limit 20""",
)
def rabitq_search(t):
    codec = C.bit_train(t.user_vectors)
    return r6(C.bit_search(C.bit_encode(t.user_vectors, codec), codec, q0(t), 20, query_bits=4), "dist")


# ---------------------------------------------------------------- inverted lists


@query(
    "ivf_train",
    f"with {E}, {lloyd_sql(1, 16, 5)} select code::int as list_id, pos::int as pos, round(c, 6) + 0.0 as x from c5",
)
def ivf_train(t):
    found = ivf.centers_frame(t.spark, ivf.train(t.user_vectors, 16, rounds=5))
    flat = found.select("list_id", F.posexplode("center").alias("pos", "x"))
    return flat.withColumn("x", F.round("x", 6) + 0.0)


@query("ivf_assign", f"with {CENT}, {ASG} select id, list_id from asg")
def ivf_assign(t):
    return lists(t).select("id", "list_id")


@query("ivf_write", f"""with {CENT}, {ASG} select list_id, count(*) as n, sum(id)::bigint as ids,
  round(sum(round(list_sum(v), 6)), 3) as total from asg group by 1""")
def ivf_write(t):
    """The stored index read back, per list."""
    back = ivf.write_index(lists(t), work_path(t.spark, "ivf"))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return back.groupBy("list_id").agg(
        F.count("*").alias("n"), F.sum("id").alias("ids"), F.round(F.sum(total), 3).alias("total"))


@query(
    "ivf_list_stats",
    f"""with {CENT}, {ASG}, s as (select list_id, count(*) as n from asg group by 1)
    select count(*) as used, sum(n)::bigint as total, min(n) as smallest, max(n) as largest,
      round(avg(n), 6) as mean, round(stddev_pop(n), 6) as deviation, 10 - count(*) as empty from s""",
)
def ivf_list_stats(t):
    return r6(ivf.list_stats(lists(t), 10), "mean", "deviation")


@query("ivf_probe", f"with {CENT}, {prb(3)} select qid, list_id, round(dist, 6) as dist, rank::int as rank from prb")
def ivf_probe(t):
    return r6(ivf.probe(centers(t), qset(t), 3), "dist")


@query(
    "ivf_dynamic_nprobe",
    f"""with {CENT}, {prb(8)} select qid, list_id, round(dist, 6) as dist, rank::int as rank
    from (select *, min(dist) over (partition by qid) as near from prb) where dist <= 1.03::double * near""",
)
def ivf_dynamic_nprobe(t):
    return r6(ivf.dynamic_probe(ivf.probe(centers(t), qset(t), 8), 1.03), "dist")


@query(
    "ivf_candidate_cost",
    f"""with {CENT}, {ASG}, {prb(3)}, s as (select list_id, count(*) as n from asg group by 1),
      c as (select qid, sum(n) as cand from prb join s using (list_id) group by qid)
    select round(avg(cand), 6) as mean_candidates, round(avg(cand) / (select count(*) from asg), 6) as scan_share,
      round(avg(cand) * 256, 6) as bytes_per_query from c""",
)
def ivf_candidate_cost(t):
    cost = ivf.candidate_cost(ivf.probe(centers(t), qset(t), 3), ivf.list_sizes(lists(t)), 64 * 4)
    return r6(cost, "mean_candidates", "scan_share", "bytes_per_query")


@query("ivf_search_flat", f"with {CENT}, {ASG}, {prb(8)}, {found('list_distance(v, qv)', 10)} {HITS}")
def ivf_search_flat(t):
    """Eight of ten lists: recall at 10 is above 0.9 (see ivf_recall)."""
    c, q = centers(t), qset(t)
    return r6(ivf.search(stored(t), ivf.probe(c, q, 8), q, 10), "dist")


@query(
    "ivf_search_sq",
    f"with {LEVELS}, {CENT[len(E) + 2:]}, {ASG}, {prb(8)}, "
    f"{found('list_distance(dv, qv)', 10, 'join sqd on sqd.id = asg.id')} {HITS}",
)
def ivf_search_sq(t):
    c, q = centers(t), qset(t)
    hit = ivf.search(stored(t, "sq"), ivf.probe(c, q, 8), q, 10, data="codes", decode=ivf.decoder(codec_of(t, "sq")))
    return r6(hit, "dist")


PQ_FOUND = found("round(list_distance(dv, qv), 9)", 10, "join pqd on pqd.id = asg.id")


@query("ivf_search_pq", f"with {PQ}, {ASG}, {prb(3)}, {PQ_FOUND} select qid, id, round(dist, 6) as dist from fnd")
def ivf_search_pq(t):
    """Plain codes by one lookup table per query; no vector is decoded."""
    q = qset(t)
    hit = A.search_codes(stored(t, "pq"), ivf.probe(centers(t), q, 3), q, book(t), 10)
    return r6(hit.drop("rank"), "dist")


@query(
    "ivf_search_rabitq",
    f"""with {CENT}, {ASG}, {TURN}, {prb(3)},
      r as materialized (select id, asg.list_id, j, sum((x - c) * h) as r from asg join e on e.vec_id = id
        join cl on cl.list_id = asg.list_id and cl.pos = e.pos join hd on i = e.pos group by all),
      v as (select id, sqrt(sum(r * r)) as norm, sum(abs(r)) / 8 / sqrt(sum(r * r)) as unit from r group by id),
      qe as (select qid, generate_subscripts(qv, 1) - 1 as pos, unnest(qv) as x from qset),
      qr as (select qid, prb.list_id, j, sum((x - c) * h) as r from prb join qe using (qid)
        join cl on cl.list_id = prb.list_id and cl.pos = qe.pos join hd on i = qe.pos group by all),
      ql as (select qid, list_id, j, r, {levels_sql(8, "partition by qid, list_id")} as rq from qr),
      d as (select qid, r.id, any_value(norm * norm) + sum(ql.r * ql.r)
          - 2 * any_value(norm / unit) * sum(case when r.r >= 0 then rq else -rq end) / 8 as dist
        from r join ql on ql.list_id = r.list_id and ql.j = r.j join v on v.id = r.id group by qid, r.id)
    select qid, id, round(dist, 6) as dist, row_number() over (partition by qid order by dist, id)::int as rank
    from d qualify rank <= 10""",
)
def ivf_search_rabitq(t):
    c, q = centers(t), qset(t)
    return r6(ivf.search_bits(stored(t, "bits"), ivf.probe(c, q, 3), q, center_matrix(t), 10, query_bits=8), "dist")


FACTOR = 25  # candidates per wanted row that product codes give to the second stage


def refine_sql(dist: str, extra: str = "") -> str:
    """Candidates of product codes in eight lists, ranked again by ``dist``."""
    return f"""{ASG}, {prb(8)}, {found("round(list_distance(dv, qv), 9)", 10 * FACTOR, "join pqd on pqd.id = asg.id")}{extra},
      ref as (select fnd.qid, fnd.id, {dist} as dist, row_number() over
        (partition by fnd.qid order by round({dist}, 12), fnd.id) as rn
        from fnd join asg on asg.id = fnd.id join qset on qset.qid = fnd.qid REST)
    select qid, id, round(dist, 6) as dist, rn::int as rank from ref where rn <= 10"""


def refined(t, form: str):
    """Product codes give candidates, a better stored form in the same lists ranks them."""
    q = qset(t)
    probes = ivf.probe(centers(t), q, 8)
    cand = A.search_codes(stored(t, "pq"), probes, q, book(t), 10 * FACTOR)
    if form == "flat":
        return ivf.refine(cand, stored(t), q, 10, probes=probes)
    return ivf.refine(cand, stored(t, form), q, 10, data="codes", decode=ivf.decoder(codec_of(t, form)), probes=probes)


@query("ivf_refine", f"with {PQ}, {refine_sql('list_distance(v, qv)').replace('REST', '')}")
def ivf_refine(t):
    return r6(refined(t, "flat"), "dist")


def levels_of(bits: int) -> str:
    """Decoded scalar codes ``sqd`` on their own, beside other relations."""
    return f""", st as (select pos, min(x) as lo, (max(x) - min(x)) / {(1 << bits) - 1}.0::double as step from e group by pos),
      sqd as (select vec_id as id, list(lo + round_even((x - lo) / step, 0) * step order by pos) as sv from e join st using (pos) group by vec_id)"""


@query("ivf_refine_sq8", f"with {PQ}, {refine_sql('list_distance(sv, qv)', levels_of(8)).replace('REST', 'join sqd on sqd.id = fnd.id')}")
def ivf_refine_sq8(t):
    return r6(refined(t, "sq"), "dist")


@query("ivf_refine_sq4", f"with {PQ}, {refine_sql('list_distance(sv, qv)', levels_of(4)).replace('REST', 'join sqd on sqd.id = fnd.id')}")
def ivf_refine_sq4(t):
    return r6(refined(t, "sq4"), "dist")


# half precision keeps eleven binary digits: rounding to a step that follows the exponent
HALF = """, hst as (select vec_id, pos, x, pow(2.0::double, greatest(floor(log2(greatest(abs(x), 1e-30::double))), -14) - 10) as step from e),
  hf as (select vec_id as id, list(round_even(x / step, 0) * step order by pos) as sv from hst group by vec_id)"""


@query("ivf_refine_fp16", f"with {PQ}, {refine_sql('list_distance(sv, qv)', HALF).replace('REST', 'join hf on hf.id = fnd.id')}")
def ivf_refine_fp16(t):
    return r6(refined(t, "fp16"), "dist")


@query(
    "knn_approx",
    f"""with {CENT}, {ASG}, {prb(8)}, {found('list_distance(v, qv)', 10,
        'join {user_vectors} u on u.id = asg.id and u.category < 5')} {HITS} where dist < 1.2""",
)
def knn_approx(t):
    """Prefilter, approximate top-k and radius in one call."""
    hit = ivf.knn_approx(stored(t), centers(t), qset(t), 10, 8, where=F.col("category") < 5, radius=1.2)
    return r6(hit, "dist")


@query(
    "approx_vs_exact",
    f"""with {CENT}, {ASG}, {prb(8)}, {found('list_distance(v, qv)', 100)},
      ex as (select qid, vec_id as id, row_number() over (partition by qid
        order by list_distance(embedding::double[], qv), vec_id) as er from {{embeddings}}, qset),
      r as (select k, ex.qid, count(*) filter (where fnd.rank <= k) / max(k)::double as r
        from ex cross join (values (10), (100)) v(k) left join fnd on fnd.qid = ex.qid and fnd.id = ex.id
        where er <= k group by all)
    select k, round(avg(r), 4) as avg_recall, round(min(r), 4) as min_recall, round(max(r), 4) as max_recall,
      round(stddev_pop(r), 4) as std_recall, round(quantile_cont(r, 0.1), 4) as p10_recall,
      round(quantile_cont(r, 0.9), 4) as p90_recall from r group by k""",
)
def approx_vs_exact(t):
    c, q = centers(t), qset(t)
    exact = S.knn_batch(t.user_vectors, q, 100)
    return Q.approx_vs_exact(exact, ivf.search(stored(t), ivf.probe(c, q, 8), q, 100), (10, 100))
