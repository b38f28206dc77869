"""Cleaning, roles, sampling and fitted preprocessing queries (inventory C, D, E, F) on FX-2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import loader as L
from ..operators import prep as P
from ..operators import roles as D
from ..operators import sampling as E
from ..session import cut_lineage
from ..sources.fixtures import fx2_raw, with_fixtures
from .common import r9
from .registry import register

# The FX-2 dataset configuration (registry-entry shape).
CFG = {
    "key": "id", "target": "target", "task": "classification",
    "drop_columns": [], "na_values": ["?"],
    "target_map": {"rich": "high"}, "column_maps": {"segment": {"AUTOMOBILE": "AUTO"}},
    "impute": True, "max_int_categories": 20, "max_samples": 1000, "test_size": 0.25,
}
KEY, TARGET = "id", "target"
FEATURES = ["nation", "acctbal", "segment", "visits", "constant_col"]
SEED_SAMPLE, SEED_SPLIT = "42", "42s"


def cleaned(spark, sf_dir):
    return C.clean(fx2_raw(spark, sf_dir), CFG)


def roles(spark, sf_dir):
    cl = cleaned(spark, sf_dir)
    return D.infer_roles(D.column_profile(cl, FEATURES + [TARGET], CFG["max_int_categories"]), CFG, TARGET)


def balanced(spark, sf_dir):
    """E2; the cap is its feature, no other query goes through it."""
    return E.balanced_subsample(cleaned(spark, sf_dir), KEY, TARGET, CFG["max_samples"], SEED_SAMPLE)


def split(spark, sf_dir):
    """The whole cleaned table, split once: fills, levels and scalers are all fitted on it."""
    return cut_lineage(E.train_test_split(cleaned(spark, sf_dir), KEY, TARGET, CFG["test_size"], SEED_SPLIT))


def encode_sets(spark, sf_dir):
    """D3: columns to encode = categorical roles + class target + integer-like numerics with
    1 < n_unique <= cap; the rest of the features are continuous."""
    rl = roles(spark, sf_dir).collect()  # one row per column
    cap = CFG["max_int_categories"]
    enc = [r["col_name"] for r in rl if r["role"] == "categorical"
           or (cap > 0 and r["integer_like"] and 1 < r["n_unique"] <= cap)]
    enc = enc + [TARGET]
    cont = [c for c in FEATURES if c not in enc]
    return enc, cont


def fitted(spark, sf_dir):
    sp = split(spark, sf_dir)
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    enc, cont = encode_sets(spark, sf_dir)
    fills = P.fit_fill_values(train, enc, cont)
    return sp, train, test, enc, cont, fills


def transformed(spark, sf_dir):
    """impute (train-fitted) then ordinal-encode (train levels, unknown -1)."""
    sp, train, test, enc, cont, fills = fitted(spark, sf_dir)
    imp = P.apply_fills(sp, fills)
    tr = imp.where(F.col("split") == "train")
    levels = P.fit_levels(tr, enc)
    return P.apply_codes(imp, levels, enc), levels


# ---------------------------------------------------------------- SQL twins
def _map_sql(col: str, mp: dict) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in mp.items())
    return f"coalesce(case {col} {cases} end, {col})"


CL_CTE = ("cl", f"""
select id, nation, acctbal, case when segment0 is null then null else {_map_sql('segment0', CFG['column_maps']['segment'])} end as segment,
       visits, constant_col, {_map_sql('target0', CFG['target_map'])} as target
from (select *, case when segment = '?' then null else segment end as segment0,
             case when target = '?' then null else target end as target0 from fx2_raw) x
where target0 is not null""")


def _h(seed: str, key: str = "id") -> str:
    return f"md5('{seed}|' || cast({key} as varchar))"


BAL_CTE = ("bal", f"""
with cls as (select target, count(*) as n_c from cl group by target),
q as (select target, least(n_c, greatest(1, {CFG['max_samples']} // (select count(*) from cls))) as quota from cls),
rk as (select cl.*, row_number() over (partition by target order by {_h(SEED_SAMPLE)}, id) as rn from cl),
pick as (select rk.* exclude (rn) from rk join q using (target) where rn <= quota),
lft as (select * from cl where id not in (select id from pick)),
extra as (select * exclude (rn) from (select *, row_number() over (order by {_h(SEED_SAMPLE)}, id) as rn from lft)
          where rn <= greatest(0, {CFG['max_samples']} - (select sum(quota) from q)))
select * from pick union all select * from extra""")


def split_sql(src: str, test_size: float, seed: str) -> str:
    return f"""
with cc as (select target, count(*) as n_c from {src} group by target),
t0 as (select target, n_c, ceil({test_size!r} * (select count(*) from {src})) as n_test, (select count(*) from {src}) as n from cc),
t1 as (select *, n_test * n_c / n as ex, floor(n_test * n_c / n) as base from t0),
tq as (select target, cast(base + case when row_number() over (order by ex - base desc, target) <= n_test - sum(base) over ()
                                 then 1 else 0 end as bigint) as quota from t1),
rk as (select s.*, row_number() over (partition by target order by {_h(seed)}, id) as rn from {src} s)
select s.*, case when s.id in (select id from rk join tq using (target) where rn <= quota) then 'test' else 'train' end as split
from {src} s"""


SP_CTE = ("sp", split_sql("cl", CFG["test_size"], SEED_SPLIT))


def psql(body, *extra):
    return with_fixtures(body, "fx2_raw", extra=[CL_CTE, *extra])


@register("c1_c5_clean", psql("select * from cl"))
def c1_c5_clean(spark, sf_dir):
    """Drop listed / Unnamed columns, NA tokens to NULL, target and column maps, NULL-target rows."""
    return cleaned(spark, sf_dir)


@register("c4_dropna_rows", with_fixtures("""
select * from (select id, nation, acctbal, case when segment = '?' then null else segment end as segment, visits,
                      constant_col, target from fx2_raw)
where id is not null and nation is not null and acctbal is not null and segment is not null and visits is not null
  and constant_col is not null and target is not null""", "fx2_raw"))
def c4_dropna_rows(spark, sf_dir):
    """C4: without imputation every row with any NULL (after NA tokens) is dropped."""
    return C.clean(fx2_raw(spark, sf_dir), {"na_values": ["?"], "impute": False})


@register("c8_numeric_frame", psql("select id, cast(nation as double) as nation, cast(acctbal as double) as acctbal, "
                                   "cast(visits as double) as visits, cast(constant_col as double) as constant_col from cl"))
def c8_numeric_frame(spark, sf_dir):
    """Numeric-only frame (non-numeric columns excluded), values as double."""
    return C.numeric_frame(cleaned(spark, sf_dir), exclude=[TARGET])


@register("c14_safe_round", psql("select id, round(acctbal / 7e0, 2) as acctbal_r from cl"))
def c14_safe_round(spark, sf_dir):
    """C14: missing-safe rounding (NULL / NaN / inf stay NULL)."""
    from ..functions.scalars import safe_round
    return cleaned(spark, sf_dir).select(KEY, safe_round(F.col("acctbal") / F.lit(7.0), 2).alias("acctbal_r"))


PROFILE_SQL = """
select 'nation' as col_name, true as is_numeric, true as integer_like, count(distinct nation) as n_unique from cl
union all select 'acctbal', true, coalesce(bool_and(abs(acctbal - round(acctbal)) <= 1e-8 + 1e-5 * abs(round(acctbal))), false),
                 count(distinct acctbal) from cl
union all select 'segment', false, false, count(distinct segment) from cl
union all select 'visits', true, true, count(distinct visits) from cl
union all select 'constant_col', true, true, count(distinct constant_col) from cl
union all select 'target', false, false, count(distinct target) from cl"""


@register("d1_integer_like", psql(f"select col_name, integer_like, is_numeric from ({PROFILE_SQL})"))
def d1_integer_like(spark, sf_dir):
    """Integer-like test per column (all non-NULL values whole; integer types always)."""
    return D.column_profile(cleaned(spark, sf_dir), FEATURES + [TARGET]).select("col_name", "integer_like", "is_numeric")


@register("d2_roles", psql(f"""
select col_name, case when not is_numeric then 'categorical'
                      when integer_like and n_unique > 1 and n_unique <= {CFG['max_int_categories']} then 'categorical'
                      else 'numeric' end as role, n_unique, integer_like
from ({PROFILE_SQL}) where col_name <> 'target'"""))
def d2_roles(spark, sf_dir):
    """Role inference (P-2) with the cardinality cap."""
    return roles(spark, sf_dir)


@register("d5_discrete_levels", psql(f"""
select col_name, cast(row_number() over (partition by col_name order by case when first_kind then k end, num, level) - 1 as integer) as pos, level
from (select col_name, level, min(k) as k, bool_or(first_kind) as first_kind, min(num) as num from (
        select {_h(SEED_SAMPLE)} as k, 'segment' as col_name, segment as level, true as first_kind, null::double as num from tr
        union all select {_h(SEED_SAMPLE)}, 'visits', cast(visits as varchar), true, cast(visits as double) from tr
        union all select {_h(SEED_SAMPLE)}, 'target', target, true, null::double from tr
        union all select {_h(SEED_SAMPLE)}, 'nation', cast(nation as varchar), false, cast(nation as double) from tr
        union all select {_h(SEED_SAMPLE)}, 'constant_col', cast(constant_col as varchar), false, cast(constant_col as double) from tr
      ) u where level is not null group by col_name, level)
where first_kind or col_name in (select col_name from (
        select 'nation' as col_name, count(distinct nation) as n from tr union all
        select 'constant_col', count(distinct constant_col) from tr) where n <= 20)""",
    SP_CTE, ("tr", "select * from sp where split = 'train'")))
def d5_discrete_levels(spark, sf_dir):
    """Allowed levels of the discrete columns of the train split."""
    sp = split(spark, sf_dir)
    tr = sp.where(F.col("split") == "train")
    rl = roles(spark, sf_dir)
    lv = D.discrete_levels(tr, rl, TARGET, "classification", E.hash_key(SEED_SAMPLE, KEY))
    return lv.withColumn("pos", F.col("pos").cast("int"))


@register("e1_uniform_cap", psql(f"select id from (select id, row_number() over (order by {_h(SEED_SAMPLE)}, id) as rn from cl) "
                                 f"where rn <= {CFG['max_samples']}"))
def e1_uniform_cap(spark, sf_dir):
    """Uniform cap to max_samples rows (first rows in hash order)."""
    return E.uniform_cap(cleaned(spark, sf_dir), KEY, CFG["max_samples"], SEED_SAMPLE).select(KEY)


@register("e2_balanced_subsample", psql("select id, target from bal", BAL_CTE))
def e2_balanced_subsample(spark, sf_dir):
    """Class-balanced subsample with deficit top-up (P-6)."""
    return balanced(spark, sf_dir).select(KEY, TARGET)


@register("e4_train_test_split", psql("select id, target, split from sp", SP_CTE))
def e4_train_test_split(spark, sf_dir):
    """Stratified train / test split (largest-remainder quotas, hash order inside classes)."""
    return split(spark, sf_dir).select(KEY, TARGET, "split")


@register("e5_train_val_test", psql(f"""
select id, target, split from s1 where split = 'train'
union all select id, target, case when split = 'test' then 'test' else 'val' end from s2""",
    ("s1", split_sql("cl", 0.2, "42t")),
    ("hold", "select * exclude (split) from s1 where split = 'test'"), ("s2", split_sql("hold", 0.5, "42tv"))))
def e5_train_val_test(spark, sf_dir):
    """E5: 80 / 10 / 10 split, stratified in both steps."""
    return E.train_val_test_split(cleaned(spark, sf_dir), KEY, TARGET, "42t").select(KEY, TARGET, "split")


# ---------------------------------------------------------------- F
TR_CTE = ("tr", "select * from sp where split = 'train'")


def _mode_sql(col: str) -> str:
    return (f"(select cast(v as varchar) from (select {col} as v, count(*) as c from tr where {col} is not null group by {col}) "
            f"order by c desc, v limit 1)")


FILL_CTE = ("fills", f"""
select 'segment' as col_name, {_mode_sql('segment')} as fill_str union all
select 'visits', {_mode_sql('visits')} union all
select 'target', {_mode_sql('target')} union all
select 'nation', cast(coalesce(median(nation), 0) as varchar) from tr union all
select 'acctbal', cast(coalesce(median(acctbal), 0) as varchar) from tr union all
select 'constant_col', cast(coalesce(median(constant_col), 0) as varchar) from tr""")


@register("f1_fill_values", psql("select col_name, round(cast(fill_str as double), 9) as fill_num from fills "
                                 "where col_name in ('nation', 'acctbal', 'constant_col', 'visits') "
                                 "union all select col_name, null from fills where col_name in ('segment', 'target')",
                                 SP_CTE, TR_CTE, FILL_CTE).replace(
    "union all select col_name, null from fills where col_name in ('segment', 'target')", "") )
def f1_fill_values(spark, sf_dir):
    """fitted fill values (mode for discrete, exact median for continuous), numeric ones."""
    _, _, _, _, _, fills = fitted(spark, sf_dir)
    return r9(fills.where(F.col("col_name").isin("nation", "acctbal", "constant_col", "visits"))
              .select("col_name", "fill_num"), "fill_num")


@register("f1_fill_labels", psql("select col_name, fill_str from fills where col_name in ('segment', 'target')",
                                 SP_CTE, TR_CTE, FILL_CTE))
def f1_fill_labels(spark, sf_dir):
    """fitted fill values of the string columns (smallest of tied modes)."""
    _, _, _, _, _, fills = fitted(spark, sf_dir)
    return fills.where(F.col("col_name").isin("segment", "target")).select("col_name", "fill_str")


IMP_CTE = ("imp", """
select id, coalesce(nation, (select cast(cast(fill_str as double) as integer) from fills where col_name = 'nation')) as nation,
       coalesce(acctbal, (select cast(fill_str as double) from fills where col_name = 'acctbal')) as acctbal,
       coalesce(segment, (select fill_str from fills where col_name = 'segment')) as segment,
       coalesce(visits, (select cast(fill_str as bigint) from fills where col_name = 'visits')) as visits,
       constant_col, target, split from sp""")
LV_CTE = ("lvl", """
select col_name, level, cast(dense_rank() over (partition by col_name order by level) - 1 as bigint) as code from (
  select distinct 'segment' as col_name, segment as level from imp where split = 'train' and segment is not null union
  select distinct 'visits', cast(visits as varchar) from imp where split = 'train' and visits is not null union
  select distinct 'target', target from imp where split = 'train' and target is not null)""")
ENC_CTE = ("enc", """
select i.id, i.nation, i.acctbal, coalesce(a.code, -1) as segment, coalesce(b.code, -1) as visits, i.constant_col,
       coalesce(c.code, -1) as target, i.split
from imp i left join lvl a on a.col_name = 'segment' and a.level = i.segment
left join lvl b on b.col_name = 'visits' and b.level = cast(i.visits as varchar)
left join lvl c on c.col_name = 'target' and c.level = i.target""")


def fsql(body, *extra):
    return psql(body, SP_CTE, TR_CTE, FILL_CTE, IMP_CTE, LV_CTE, ENC_CTE, *extra)


@register("f3_level_codes", fsql("select col_name, level, code from lvl"))
def f3_level_codes(spark, sf_dir):
    """level tables of the encoded columns (lexicographic string order, P-9)."""
    _, levels = transformed(spark, sf_dir)
    return levels


@register("f5_fit_transform", fsql("select id, nation, round(acctbal, 9) as acctbal, segment, visits, constant_col, target, split from enc"))
def f5_fit_transform(spark, sf_dir):
    """Train-fitted imputation and ordinal encoding applied to train and test (unknown -1)."""
    enc, _ = transformed(spark, sf_dir)
    return r9(enc.select(KEY, "nation", "acctbal", "segment", "visits", "constant_col", TARGET, "split"), "acctbal")


@register("f4_standardise", fsql("""
select id, split, round((cast(nation as double) - m1) / case when s1 = 0 or s1 is null then 1 else s1 end, 9) as nation_z,
       round((acctbal - m2) / case when s2 = 0 or s2 is null then 1 else s2 end, 9) as acctbal_z,
       round((cast(constant_col as double) - m3) / case when s3 = 0 or s3 is null then 1 else s3 end, 9) as constant_col_z
from enc, (select avg(nation) as m1, stddev_pop(nation) as s1, avg(acctbal) as m2, stddev_pop(acctbal) as s2,
                  avg(constant_col) as m3, stddev_pop(constant_col) as s3 from enc where split = 'train') st"""))
def f4_standardise(spark, sf_dir):
    """standardise continuous features with train mean / population std (zero std -> 1)."""
    enc, _ = transformed(spark, sf_dir)
    cols = ["nation", "acctbal", "constant_col"]
    st = P.fit_scaler(enc.where(F.col("split") == "train"), cols)
    z = P.apply_scaler(enc, st, cols, "_z")
    return r9(z.select(KEY, "split", *[f"{c}_z" for c in cols]), *[f"{c}_z" for c in cols])


@register("f8_label_space", fsql("""
select label, cast(dense_rank() over (order by label) - 1 as bigint) as idx from (
  select distinct target as label from imp where split = 'train' union select distinct target from imp where split = 'test')"""))
def f8_label_space(spark, sf_dir):
    """F8: label space = sorted union of train and test labels."""
    sp = split(spark, sf_dir)
    return P.label_space((sp.where(F.col("split") == "train"), TARGET), (sp.where(F.col("split") == "test"), TARGET))


@register("f9_decode_codes", fsql("""
select e.id, l.level as decoded from enc e,
  (select list(level order by code) as lv from lvl where col_name = 'target') t,
  lateral (select t.lv[least(greatest(cast(e.target + e.id % 3 - 1 as integer), 0), len(t.lv) - 1) + 1] as level) l"""))
def f9_decode_codes(spark, sf_dir):
    """codes (shifted by -1 / 0 / +1) decoded back to labels, clipped to the valid range."""
    enc, levels = transformed(spark, sf_dir)
    x = enc.withColumn("_c", F.col(TARGET) + F.col(KEY) % 3 - 1)
    out = P.decode_codes(x, "_c", levels.where(F.col("col_name") == TARGET).select("level", "code"), "decoded")
    return out.select(KEY, "decoded")


F6_NUM = ["nation", "acctbal", "constant_col"]
F6_CAT = ["segment", "visits"]


@register("f6_feature_matrix", fsql(
    " union all ".join(
        f"select id, split, '{c}' as feature, round((cast({c} as double) - m_{c}) / "
        f"case when s_{c} = 0 or s_{c} is null then 1 else s_{c} end, 9) as value from imp, st"
        for c in F6_NUM)
    + " union all select i.id, i.split, 'segment=' || l.level, 1e0 from imp i join lvl l "
      "on l.col_name = 'segment' and l.level = i.segment"
    + " union all select i.id, i.split, 'visits=' || l.level, 1e0 from imp i join lvl l "
      "on l.col_name = 'visits' and l.level = cast(i.visits as varchar)",
    ("st", "select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in F6_NUM)
     + " from imp where split = 'train'")))
def f6_feature_matrix(spark, sf_dir):
    """Train-fitted scaled numerics + one-hot categoricals as a sparse (id, feature, value) matrix."""
    sp, train, test, enc, cont, fills = fitted(spark, sf_dir)
    imp = P.apply_fills(sp, fills)
    m = P.feature_matrix(imp, imp.where(F.col("split") == "train"), [KEY, "split"], F6_NUM, F6_CAT)
    return r9(m, "value")


_Z = lambda c: f"round((cast({c} as double) - m_{c}) / case when s_{c} = 0 or s_{c} is null then 1 else s_{c} end, 6)"


@register("f7_feature_vectors", fsql(f"""
select id, split, cast((select {len(F6_NUM)} + count(*) from lvl where col_name in ('segment', 'visits')) as integer) as n_features,
       (select string_agg(i || ':' || cast(round(v * 1e6) as bigint), ',' order by i) from (
          select unnest([0, 1, 2]) as i, unnest([{', '.join(_Z(c) for c in F6_NUM)}]) as v
          union all select {len(F6_NUM)} + a.code, 1e0 from (select 1) where a.code is not null
          union all select {len(F6_NUM)} + (select count(*) from lvl where col_name = 'segment') + b.code, 1e0 from (select 1) where b.code is not null)
        where v is not null and v <> 0) as vector
from imp left join lvl a on a.col_name = 'segment' and a.level = segment
left join lvl b on b.col_name = 'visits' and b.level = cast(visits as varchar), st""",
    ("st", "select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in F6_NUM) + " from imp where split = 'train'")))
def f7_feature_vectors(spark, sf_dir):
    """the sparse feature vector of every row of both sides, fitted on the train side, as text."""
    sp, train, test, enc, cont, fills = fitted(spark, sf_dir)
    imp = P.apply_fills(sp, fills)
    v = P.feature_vectors(imp, imp.where(F.col("split") == "train"), F6_NUM, F6_CAT)
    pair = F.zip_with("indices", "values", lambda i, x: F.concat(i, F.lit(":"), F.round(F.round(x, 6) * 1e6).cast("bigint")))
    return v.select(KEY, "split", "n_features", F.array_join(pair, ",").alias("vector"))


# ---------------------------------------------------------------- E3, E7, F10, G4
@register("e3_shuffle", psql(f"select id, row_number() over (order by {_h('7')}, id) - 1 as position from cl"))
def e3_shuffle(spark, sf_dir):
    """Deterministic shuffle of the whole table, as each row's place."""
    return E.shuffled_position(cleaned(spark, sf_dir), KEY, "7").select(KEY, "position")


@register("e7_load_train_test", fsql("""
select e.id, e.split, e.segment, e.visits, e.target,
       round((cast(e.nation as double) - m1) / case when s1 = 0 or s1 is null then 1 else s1 end, 9) as nation_z,
       round((e.acctbal - m2) / case when s2 = 0 or s2 is null then 1 else s2 end, 9) as acctbal_z
from enc e, (select avg(nation) as m1, stddev_pop(nation) as s1, avg(acctbal) as m2, stddev_pop(acctbal) as s2
             from enc where split = 'train') st"""))
def e7_load_train_test(spark, sf_dir):
    """The end-to-end loader (clean, split, roles, impute, encode, scale) without a row cap."""
    d = L.load_train_test(fx2_raw(spark, sf_dir), CFG | {"max_samples": 0, "features": FEATURES}, SEED_SAMPLE, SEED_SPLIT)
    return r9(d.frame.select(KEY, "split", "segment", "visits", TARGET, "nation_z", "acctbal_z"), "nation_z", "acctbal_z")


@register("f10_assemble_decoded", fsql("""
select e.id, l.level as segment, e.nation, cast(v.level as bigint) as visits, round(e.acctbal, 9) as acctbal, t.level as target
from enc e join lvl l on l.col_name = 'segment' and l.code = greatest(e.segment, 0)
join lvl v on v.col_name = 'visits' and v.code = greatest(e.visits, 0)
join lvl t on t.col_name = 'target' and t.code = greatest(e.target, 0)"""))
def f10_assemble_decoded(spark, sf_dir):
    """arrays of numerics and category codes back to named columns in template order."""
    enc, levels = transformed(spark, sf_dir)
    arrays = enc.select(KEY, F.array(F.col("nation").cast("double"), F.col("acctbal")).alias("numeric"),
                        F.array("segment", "visits", TARGET).alias("codes"))
    template = [("segment", "string"), ("nation", "int"), ("visits", "bigint"), ("acctbal", "double"), (TARGET, "string")]
    return r9(P.assemble_decoded(arrays, [KEY], template, ["nation", "acctbal"], ["segment", "visits", TARGET], levels), "acctbal")


@register("g4_role_override", psql(f"""
select col_name, case when col_name in ('nation', 'target') or not is_numeric then 'categorical'
                      when integer_like and n_unique > 1 and n_unique <= {CFG['max_int_categories']} then 'categorical'
                      else 'numeric' end as role
from ({PROFILE_SQL})"""))
def g4_role_override(spark, sf_dir):
    """Generator metadata — listed categoricals and the class target override the inferred roles."""
    return D.override_roles(roles(spark, sf_dir), ["nation"], TARGET)
