"""The catalogue's queries as plain SQL over the test tables, for an independent check."""

from __future__ import annotations

import re

# Named parts; a query gets those it mentions, and those they mention.
PARTS: dict[str, str] = {
    "raw_patients": """
        select c_custkey as patientunitstayid,
          case when c_custkey % 50 = 7 then null when c_custkey % 47 = 3 then 'n/a'
               when (c_custkey * 31) % 100 > 89 then '> 89'
               else cast((c_custkey * 31) % 100 as varchar) end as age,
          case c_custkey % 4 when 0 then 'Male' when 1 then 'Female' when 2 then 'male'
               else null end as gender,
          case when c_nationkey < 3 then null else cast(c_nationkey as varchar) end as ethnicity,
          case when c_custkey % 9 = 0 then null
               else cast(150 + c_custkey % 50 as double) end as admissionheight,
          50 + c_acctbal / 200 as admissionweight,
          case when c_custkey % 6 = 0 then null
               else cast((c_custkey * 17) % 1001 as double) / 1000 end as ml_risk_score,
          c_mktsegment as unittype,
          case when c_custkey % 29 = 0 then null when c_acctbal < 500 then 'Expired'
               when c_acctbal < 1000 then 'EXPIRED' else 'Alive' end as hospitaldischargestatus
        from customer""",
    "raw_vitals": """
        select user_id as patientunitstayid,
          cast(epoch_us(ts) - 1704067200000000 as double) / 60000000 as observationoffset,
          case when event_id % 11 = 0 then null else value + 40 end as heartrate,
          case when event_id % 17 = 0 then null else 12 + value / 20 end as respiration,
          case when event_id % 13 = 0 then null else 100 - value / 4 end as sao2,
          90 + value / 3 as systemicsystolic,
          case when event_id % 9 = 0 then null else 55 + value / 5 end as systemicdiastolic,
          case when event_id % 7 = 0 then null else 37 + (value - 50) / 20 end as temperature,
          case when event_type = 'error' then value / 10 else null end as cvp
        from events""",
    "order_lines": """
        select * from lineitem join orders on l_orderkey = o_orderkey
          join part on l_partkey = p_partkey""",
    "raw_labs": """
        select o_custkey as patientunitstayid,
          cast(l_linenumber * 1440 as double) as labresultoffset,
          case p_type when 'MEDIUM' then 'creatinine' when 'STANDARD' then 'glucose'
               when 'LARGE' then 'potassium' when 'PROMO' then 'Sodium'
               when 'SMALL' then 'lactate' else 'alt' end as labname,
          case when l_partkey % 97 = 0 then '<5' when l_partkey % 89 = 0 then null
               else cast(l_quantity as varchar) end as labresult
        from order_lines""",
    "raw_diagnosis": """
        select concat(cast(o_custkey as varchar), case l_linenumber when 6 then '.7'
                      when 7 then 'x' else '' end) as patientunitstayid,
          cast(l_linenumber * 60 as double) as diagnosisoffset, p_brand as diagnosisstring,
          cast(100 + p_size as varchar) as icd9code,
          case when l_linenumber = 1 then 'Primary' else 'Secondary' end as diagnosispriority
        from order_lines""",
    "treatment": """
        select o_custkey as patientunitstayid, cast(l_linenumber * 30 as double) as treatmentoffset,
          p_name as treatmentstring
        from order_lines""",
    "raw_apache": """
        select case o_orderpriority when '5-LOW' then 'unknown'
                    else cast(o_custkey as varchar) end as patientunitstayid,
          o_totalprice / 5000 as apachescore,
          case when o_orderstatus = 'P' then null
               else 1 / (1 + exp(-(o_totalprice / 5000 - 60) / 15))
               end as predictedhospitalmortality
        from orders""",
    "patients": """
        select patientunitstayid,
          try_cast(case when age = '> 89' then '90' else age end as double) as age,
          coalesce(gender, 'Unknown') as gender, coalesce(ethnicity, 'Unknown') as ethnicity,
          admissionheight, admissionweight, ml_risk_score, unittype, hospitaldischargestatus,
          cast(coalesce(lower(hospitaldischargestatus) = 'expired', false) as integer)
            as hospital_mortality
        from raw_patients""",
    "vitals": """
        select * from raw_vitals
        where (heartrate between 0 and 300 or heartrate is null)
          and (sao2 between 50 and 100 or sao2 is null)
          and (temperature between 25 and 45 or temperature is null)""",
    "labs": """
        select patientunitstayid, labresultoffset, labname,
          try_cast(labresult as double) as labresult
        from raw_labs where labresult is not null""",
    "diagnosis": """
        select cast(trunc(try_cast(patientunitstayid as double)) as bigint) as patientunitstayid,
          diagnosisoffset, diagnosisstring, icd9code, diagnosispriority
        from raw_diagnosis where try_cast(patientunitstayid as double) is not null""",
    "apache": """
        select cast(patientunitstayid as bigint) as patientunitstayid, apachescore,
          predictedhospitalmortality
        from raw_apache where try_cast(patientunitstayid as double) is not null""",
    "signs": """
        select patientunitstayid, avg(heartrate) as hr_mean, stddev_samp(heartrate) as hr_std,
          avg(sao2) as sao2_mean, min(sao2) as sao2_min, avg(respiration) as resp_mean,
          avg(systemicsystolic) as sbp_mean, avg(systemicdiastolic) as dbp_mean,
          avg(temperature) as temp_mean
        from vitals group by patientunitstayid""",
    "means": """
        select patientunitstayid,
          avg(labresult) filter (lower(labname) = 'creatinine') as lab_creatinine,
          avg(labresult) filter (lower(labname) = 'glucose') as lab_glucose,
          avg(labresult) filter (lower(labname) = 'hemoglobin') as lab_hemoglobin,
          avg(labresult) filter (lower(labname) = 'lactate') as lab_lactate,
          avg(labresult) filter (lower(labname) = 'potassium') as lab_potassium,
          avg(labresult) filter (lower(labname) = 'sodium') as lab_sodium,
          avg(labresult) filter (lower(labname) = 'wbc') as lab_wbc
        from labs
        where lower(labname) in ('creatinine', 'glucose', 'potassium', 'sodium', 'lactate',
                                 'hemoglobin', 'wbc')
        group by patientunitstayid""",
    "scored": """
        select * from patients left join apache using (patientunitstayid)""",
    "features": """
        select * from scored left join signs using (patientunitstayid)
          left join means using (patientunitstayid)""",
    "readings": """
        unpivot (select patientunitstayid, observationoffset, heartrate, respiration, sao2,
                   systemicsystolic, systemicdiastolic, temperature, cvp from vitals)
        on heartrate, respiration, sao2, systemicsystolic, systemicdiastolic, temperature, cvp
        into name vital value value""",
    "ranked": """
        select *, row_number() over (partition by patientunitstayid, vital
                    order by observationoffset desc, value desc) as rn,
          count(*) over (partition by patientunitstayid, vital) as n
        from readings where vital not in ('systemicdiastolic', 'cvp')""",
    "tails": """
        select patientunitstayid, vital, max(n) as n,
          sum(value * pow(2.0::double / 3, rn - 1)) / sum(pow(2.0::double / 3, rn - 1)) as ewm,
          stddev_samp(case when rn <= 10 then value end) as std10,
          (max(case when rn = 1 then value end) - max(case when rn = least(5, n) then value end))
            / greatest(max(least(5, n)) - 1, 1) as trend
        from ranked group by patientunitstayid, vital""",
    "ends": """
        select patientunitstayid, max(observationoffset) as last_offset
        from vitals group by patientunitstayid""",
    "predicted": """
        select patientunitstayid, vital, step, last_offset + 5 * step as observationoffset,
          round(ewm + trend * 0.3::double * step, 2) as value, std10
        from tails join ends using (patientunitstayid), range(1, 7) s(step) where n >= 3""",
}

# A tree of two levels, split by split. Thresholds are the middles between neighbouring values.
_TREE_FEATURES = ["age", "admissionheight", "admissionweight", "gender_enc", "unittype_enc"]
_GINI = "(1 - pow({0}0 / ({0}0 + {0}1), 2) - pow({0}1 / ({0}0 + {0}1), 2))"


def _best_split(rows: str, node: str) -> str:
    """Per node of ``rows`` the split with the largest gain, each side with ten rows or more."""
    return f"""
        with tried as (
          select {node} as node, c.feature, c.threshold,
            sum(case when y = 0 and value <= threshold then weight else 0 end) as l0,
            sum(case when y = 1 and value <= threshold then weight else 0 end) as l1,
            sum(case when y = 0 and value > threshold then weight else 0 end) as r0,
            sum(case when y = 1 and value > threshold then weight else 0 end) as r1,
            count(*) filter (value <= threshold) as nl, count(*) filter (value > threshold) as nr
          from {rows} t join cuts c on c.feature = t.feature group by all),
        gains as (
          select *, l0 + r0 as p0, l1 + r1 as p1 from tried where nl >= 10 and nr >= 10)
        select node, arg_max(feature, gain) as feature, arg_max(threshold, gain) as threshold,
          max(gain) as gain, max(p0 + p1) as w
        from (select *, {_GINI.format("p")}
                - (l0 + l1) / (p0 + p1) * {_GINI.format("l")}
                - (r0 + r1) / (p0 + p1) * {_GINI.format("r")} as gain from gains)
        where gain > 0 group by node"""


def _side(split: str, of: str) -> str:
    cases = " ".join(f"when '{f}' then {of}.{f}" for f in _TREE_FEATURES)
    return f"(case {split}.feature {cases} end <= {split}.threshold)"


PARTS |= {
    "tree_rows": """
        select patientunitstayid, age, gender, unittype, admissionheight, apachescore,
          floor(admissionweight) as admissionweight,
          cast(coalesce((admissionheight > 170 and age > 40) or apachescore > 80, false)
               as integer) as y
        from features""",
    "marked": """
        select *, place < ceil(0.2::double * n) as is_test
        from (select *, row_number() over (partition by y order by
                  md5(concat_ws('|', patientunitstayid, '42')), patientunitstayid,
                  gender nulls first, unittype nulls first, age nulls first,
                  admissionheight nulls first, admissionweight nulls first) - 1 as place,
                count(*) over (partition by y) as n from tree_rows)""",
    "codes": """
        select unit, cast(row_number() over (order by unit) - 1 as double) as unittype_enc
        from (select distinct coalesce(unittype, 'unknown') as unit from marked where not is_test)""",
    "filled": """
        select row_number() over () as id, patientunitstayid, apachescore, is_test, m.y,
          coalesce(age, a) as age, coalesce(admissionheight, h) as admissionheight,
          coalesce(admissionweight, k) as admissionweight,
          case when lower(gender) = 'male' then 1.0::double else 0.0::double end as gender_enc,
          unittype_enc, weight
        from marked m
          join (select median(age) as a, median(admissionheight) as h, median(admissionweight) as k
                from marked where not is_test) on true
          join codes on unit = coalesce(unittype, 'unknown')
          join (select y, sum(count(*)) over () / (count(*) over () * count(*))::double as weight
                from marked where not is_test group by y) w on w.y = m.y""",
    "asked": f"""
        unpivot (select id, y, weight, {", ".join(_TREE_FEATURES)} from filled where not is_test)
        on {", ".join(_TREE_FEATURES)} into name feature value value""",
    "cuts": """
        select feature, threshold from (
          select feature, (value + lag(value) over (partition by feature order by value))
            / 2 as threshold
          from (select distinct feature, value from asked)) where threshold is not null""",
    "root_split": _best_split("asked", "0"),
    "halved": f"""
        select f.id, {_side("s", "f")} as first from filled f, root_split s""",
    "child_splits": _best_split("(select * from asked join halved using (id))", "first"),
    "quarters": f"""
        select f.*, h.first, {_side("s", "f")} as second
        from filled f join halved h using (id) left join child_splits s on s.node = h.first""",
    "tips": """
        select first, second, sum(case when y = 0 then weight else 0 end) as w0,
          sum(case when y = 1 then weight else 0 end) as w1
        from quarters where not is_test group by first, second""",
    "kept_splits": """
        select s.* from child_splits s where (
          select count(distinct w1 > w0) from tips t where t.first = s.node) > 1""",
    "root_kept": """
        select (select count(*) from kept_splits) > 0 or (
          select count(distinct w1 > w0) from (
            select first, sum(w0) as w0, sum(w1) as w1 from tips group by first)) > 1 as kept""",
    "placed": """
        select q.patientunitstayid, q.apachescore, q.is_test, q.y, q.weight, case
          when not kept then 'whole' when k.node is null then concat(first, '')
          else concat(first, ' ', second) end as leaf
        from quarters q left join kept_splits k on k.node = q.first, root_kept""",
    "leaves": """
        select leaf, sum(weight) as w, sum(case when y = 1 then weight else 0 end) as w1
        from placed where not is_test group by leaf""",
    "inner_nodes": """
        select feature, gain, w from root_split, root_kept where kept
        union all select feature, gain, w from kept_splits""",
}

_DRAW = "cast(('0x' || substr(md5(key), {at}, 12)) as bigint)"
_UNIFORM = f"(({_DRAW} + 0.5::double) / 281474976710656::double)"

_SCORED_ORDER = ", ".join(
    f"{c} asc nulls first"
    for c in (
        "patientunitstayid", "age", "gender", "ethnicity", "admissionheight", "admissionweight",
        "unittype", "hospitaldischargestatus", "ml_risk_score", "hospital_mortality",
        "apachescore", "predictedhospitalmortality",
    )
)

_TOP_DIAGNOSES = """
    select diagnosisstring, count(*) as count from diagnosis group by diagnosisstring
    order by count desc, diagnosisstring limit 15"""

_NUMBERS = ["age", "admissionheight", "admissionweight", "apachescore", "predictedhospitalmortality"]

_AUC = """
    with s as (select {score} as score, hospital_mortality as y from scored
               where {score} is not null),
    r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1)
                      / 2.0::double as place from s)
    select (sum(case when y = 1 then place end) - sum(y) * (sum(y) + 1) / 2.0::double)
      / (sum(y)::double * (count(*) - sum(y))) as auc from r"""

QUERIES: dict[str, str] = {
    "clean_patients": "select * from patients",
    "clean_vitals": "select * from vitals",
    "clean_labs": "select * from labs",
    "clean_keys": "select * from diagnosis",
    "clean_apache": "select * from apache",
    "vitals_for_stays": """
        select * from vitals where patientunitstayid in
          (select patientunitstayid from patients where hospital_mortality = 1)""",
    "labs_for_stays": """
        select * from labs where patientunitstayid in
          (select patientunitstayid from patients where hospital_mortality = 1)""",
    "finite_output": """
        select o_orderkey, case when o_orderstatus = 'P'
          or o_orderpriority in ('1-URGENT', '2-HIGH') then null else o_totalprice end as value
        from orders""",
    "csv_ingest": "select * from labs",
    "keyed_layout": "select * from vitals",
    "vitals_agg": "select * from signs",
    "lab_pivot": "select * from means",
    "key_lab_rows": """
        select * from labs where lower(labname) in ('creatinine', 'glucose', 'potassium',
          'sodium', 'lactate', 'hemoglobin', 'wbc')""",
    "patients_apache": "select * from scored",
    "apache_deduped": """
        select patientunitstayid, apachescore, predictedhospitalmortality from (
          select *, row_number() over (partition by patientunitstayid order by
            apachescore desc nulls last, predictedhospitalmortality desc nulls last) as rn
          from apache) where rn = 1""",
    "feature_table": "select * from features",
    "patient_summary": """
        select patientunitstayid, age, gender, ethnicity, admissionheight, admissionweight,
          unittype, hospitaldischargestatus, hospital_mortality, apachescore,
          predictedhospitalmortality, hr_mean, hr_std, sao2_mean, sao2_min, resp_mean, sbp_mean,
          dbp_mean, temp_mean, cast(null as double) as ml_risk_score,
          cast(null as integer) as ml_prediction
        from features""",
    "cohort_stats": """
        select count(*) as total_patients,
          round(coalesce(avg(hospital_mortality), 0) * 100, 2) as mortality_rate,
          round(coalesce(avg(age), 0), 1) as avg_age,
          round(coalesce(avg(apachescore), 0), 1) as avg_apache_score
        from scored""",
    "patient_count": "select count(*) as n from scored",
    "unit_breakdown": """
        select unittype, count(*) as count, avg(hospital_mortality) * 100 as mortality_pct,
          avg(apachescore) as avg_apache
        from scored group by unittype""",
    "unit_top10": """
        select unittype, count(*) as count, avg(hospital_mortality) * 100 as mortality_pct,
          avg(apachescore) as avg_apache
        from scored group by unittype order by count desc, unittype limit 10""",
    "unit_share": """
        select unittype, count(*) as count,
          count(*)::double / sum(count(*)) over () as share
        from scored group by unittype""",
    "mortality_by_age": """
        select age_group, count(hospital_mortality) as count,
          round(avg(hospital_mortality) * 100, 2) as mortality_pct
        from (select hospital_mortality, case when age > 0 and age <= 18 then '<18'
                when age > 18 and age <= 40 then '18-40' when age > 40 and age <= 60 then '40-60'
                when age > 60 and age <= 75 then '60-75' when age > 75 and age <= 120 then '75+'
                end as age_group from scored)
        where age_group is not null group by age_group""",
    "top_diagnoses": _TOP_DIAGNOSES,
    "diagnosis_labels": f"""
        select diagnosisstring, count, substr(diagnosisstring, 1, 7) as label
        from ({_TOP_DIAGNOSES})""",
    "lab_summary": """
        select patientunitstayid, labname, avg(labresult) as mean, min(labresult) as min,
          max(labresult) as max, count(labresult) as count
        from labs group by patientunitstayid, labname""",
    "lab_top_k": """
        select patientunitstayid, labname, count, cast(place as integer) as place,
          place <= 4 as is_default
        from (select *, row_number() over (partition by patientunitstayid
                order by count desc, labname) as place
              from (select patientunitstayid, labname, count(*) as count from labs
                    group by patientunitstayid, labname))
        where place <= 8""",
    "apache_box": """
        with rows as (select case hospital_mortality when 1 then 'Expired' else 'Survived' end
                        as outcome, apachescore as v from scored where apachescore is not null),
        q as (select outcome, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
                quantile_cont(v, 0.75) as q3 from rows group by outcome)
        select outcome, q1, median, q3, count(*) as count, min(v) as min, max(v) as max,
          min(v) filter (v >= q1 - 1.5 * (q3 - q1)) as lower_whisker,
          max(v) filter (v <= q3 + 1.5 * (q3 - q1)) as upper_whisker
        from rows join q using (outcome) group by outcome, q1, median, q3""",
    "box_by_sketch": """
        select case hospital_mortality when 1 then 'Expired' else 'Survived' end as outcome,
          count(*) as count, min(apachescore) as min, max(apachescore) as max, true as ranks_close
        from scored where apachescore is not null group by 1""",
    "patient_page": f"select * from scored order by {_SCORED_ORDER} limit 100 offset 200",
    "patient_page_after": f"select * from scored order by {_SCORED_ORDER} limit 100 offset 300",
    "search_text": f"""
        select * from scored where unittype ilike '%Build%' or gender ilike '%Build%'
        order by {_SCORED_ORDER} limit 500 offset 50""",
    "search_id": f"""
        select * from scored where patientunitstayid = 42 order by {_SCORED_ORDER} limit 100""",
    "search_totals": """
        select least(count(*), 100) as page_rows, count(*) as total from scored
        where (unittype ilike '%male%' or gender ilike '%male%')
          and (ml_risk_score >= 0.5 or apachescore >= 60)""",
    "high_risk": "select * from scored where ml_risk_score >= 0.5 or apachescore >= 60",
    "patient_lookup": """
        select * from scored where patientunitstayid in (select patientunitstayid from vitals)""",
    "vitals_series": "select * from vitals",
    "labs_series": "select * from labs",
    "vitals_of_list": """
        select * from vitals where patientunitstayid in (select 37 * k from range(1, 201) t(k))""",
    "labs_of_list": """
        select * from labs where patientunitstayid in (select 37 * k from range(1, 201) t(k))""",
    "stay_diagnoses": """
        select patientunitstayid, diagnosisoffset as "Offset (min)",
          diagnosisstring as "Diagnosis", icd9code as "ICD9", diagnosispriority as "Priority"
        from diagnosis where patientunitstayid in (select patientunitstayid from vitals)""",
    "stay_treatments": """
        select patientunitstayid, treatmentoffset as "Offset (min)",
          treatmentstring as "Treatment"
        from treatment where patientunitstayid in (select patientunitstayid from vitals)""",
    "lab_line": """
        select patientunitstayid, labname, labresultoffset / 60 as time_h, labresult
        from labs where labname in ('glucose', 'Sodium')""",
    "display_rows": """
        select patientunitstayid, age, gender, unittype, apachescore, hospital_mortality,
          ml_risk_score,
          case when ml_risk_score is null then 'blank' when ml_risk_score >= 0.7 then 'red'
               when ml_risk_score >= 0.4 then 'yellow' else 'green' end as risk,
          case hospital_mortality when 1 then 'Expired' when 0 then 'Survived' end as outcome
        from scored""",
    "vital_long": """
        select patientunitstayid, observationoffset, vital, value,
          observationoffset / 60 as time_h from readings""",
    "downsample": """
        select * exclude (place, n) from (
          select *, row_number() over (partition by patientunitstayid order by observationoffset)
              - 1 as place,
            count(*) over (partition by patientunitstayid) as n from vitals)
        where place % greatest(n // 20, 1) = 0""",
    "ewm_last": "select patientunitstayid, vital, ewm from tails",
    "tail_std": "select patientunitstayid, vital, std10 from tails",
    "trend": "select patientunitstayid, vital, trend from tails",
    "forecast": """
        select patientunitstayid, vital, cast(step as integer) as step, observationoffset, value
        from predicted""",
    "forecast_noise": f"""
        with steps as (
          select *, concat_ws('|', patientunitstayid, vital, step, '7') as key
          from tails join ends using (patientunitstayid), range(1, 13) s(step) where n >= 3),
        draws as (
          select *, sum(sqrt(-2 * ln({_UNIFORM.format(at=1)}))
                        * cos(2 * pi() * {_UNIFORM.format(at=13)})
                        * coalesce(std10, 0) * 0.2::double)
              over (partition by patientunitstayid, vital order by step
                    rows unbounded preceding) as noise from steps)
        select patientunitstayid, vital, cast(step as integer) as step,
          last_offset + 5 * step as observationoffset,
          round(ewm + trend * 0.3::double * step + noise, 2) as value
        from draws""",
    "forecast_band": """
        select patientunitstayid, vital, cast(step as integer) as step, value - std10 as lower,
          value + std10 as upper from predicted""",
    "future_offsets": """
        select patientunitstayid, cast(step as integer) as step,
          last_offset + 5 * step as observationoffset from ends, range(1, 7) s(step)""",
    "history_tail": """
        select * exclude (rn), observationoffset / 60 as time_h, cast(rn as integer) as place
        from (select *, row_number() over (partition by patientunitstayid
                order by observationoffset desc) as rn from vitals)
        where rn <= 50""",
    "forecast_line": """
        select patientunitstayid, vital, cast(step as integer) as step,
          observationoffset / 60 as time_h, value from predicted
        union all
        select e.patientunitstayid, t.vital, 0 as step, last_offset / 60 as time_h,
          case t.vital when 'heartrate' then heartrate when 'respiration' then respiration
            when 'sao2' then sao2 when 'systemicsystolic' then systemicsystolic
            when 'temperature' then temperature end as value
        from ends e join vitals v on v.patientunitstayid = e.patientunitstayid
            and v.observationoffset = e.last_offset
          join tails t on t.patientunitstayid = e.patientunitstayid and t.n >= 3""",
    "encode_features": """
        select patientunitstayid,
          case when lower(gender) = 'male' then 1.0::double else 0.0::double end as gender_enc,
          cast(dense_rank() over (order by coalesce(unittype, 'unknown')) - 1 as double)
            as unittype_enc
        from patients""",
    "risk_label": """
        select patientunitstayid, ml_risk_score, case when ml_risk_score >= 0.7 then 'HIGH'
          when ml_risk_score >= 0.4 then 'MODERATE' else 'LOW' end as risk_label from patients""",
    "risk_band": """
        select patientunitstayid, ml_risk_score, case when ml_risk_score is null then 'blank'
          when ml_risk_score >= 0.7 then 'red' when ml_risk_score >= 0.4 then 'yellow'
          else 'green' end as risk_band from patients""",
    "median_impute": "with m as (select "
    + ", ".join(f"median({c}) as m_{c}" for c in _NUMBERS)
    + " from scored) select patientunitstayid, "
    + ", ".join(f"coalesce({c}, m_{c}) as {c}" for c in _NUMBERS)
    + " from scored, m",
    "standardise": "with m as (select "
    + ", ".join(f"avg({c}) as a_{c}, stddev_pop({c}) as d_{c}" for c in _NUMBERS)
    + " from scored) select patientunitstayid, "
    + ", ".join(f"({c} - a_{c}) / d_{c} as {c}" for c in _NUMBERS)
    + " from scored, m",
    "class_weights": """
        select hospital_mortality, count(*) as rows,
          sum(count(*)) over () / (count(*) over () * count(*))::double as weight
        from scored group by hospital_mortality""",
    "auc": _AUC.format(score="admissionweight"),
    "auc_tied": _AUC.format(score="age"),
    "auc_bounds": f"""
        with b as (
          select greatest(0, least(499, floor((admissionweight - 45) / 55 * 500))) as part,
            sum(hospital_mortality)::double as pos, sum(1 - hospital_mortality)::double as neg
          from scored where admissionweight is not null group by part),
        c as (select *, coalesce(sum(neg) over (order by part
                rows between unbounded preceding and 1 preceding), 0) as below from b),
        d as (select sum(pos * below) / (sum(pos) * sum(neg)) as lo,
                sum(pos * (below + neg)) / (sum(pos) * sum(neg)) as hi from c),
        e as ({_AUC.format(score="admissionweight")})
        select lo, hi, auc between lo and hi as holds from d, e""",
    "class_report": """
        with s as (select hospital_mortality as y, cast(admissionweight < 56 as integer) as p
                   from scored),
        c as (select k as class, sum(cast(y = k and p = k as integer)) as hits,
                sum(cast(y = k as integer)) as support, sum(cast(p = k as integer)) as said
              from s, (values (0), (1)) v(k) group by k),
        m as (select cast(class as varchar) as class, hits, support,
                hits::double / said as precision, hits::double / support as recall,
                2 * (hits::double / said) * (hits::double / support)
                  / (hits::double / said + hits::double / support) as f1 from c)
        select class, precision, recall, f1, cast(support as bigint) as support from m
        union all
        select 'accuracy', sum(hits)::double / sum(support), sum(hits)::double / sum(support),
          sum(hits)::double / sum(support), cast(sum(support) as bigint) from m
        union all
        select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint)
        from m
        union all
        select 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
          cast(sum(support) as bigint) from m""",
    "positive_rate": """
        select count(*) as rows, avg(hospital_mortality) as positive_rate from scored""",
    "tree_score": """
        select patientunitstayid, apachescore, w1 / w as risk_score
        from placed join leaves using (leaf)""",
    "tree_importance": """
        with g as (select feature, sum(gain * w) as g from inner_nodes group by feature)
        select feature, g / sum(g) over () as importance from g""",
    "score_writeback": """
        with s as (
          select patientunitstayid, (patientunitstayid * 13) % 1000 / 1000.0::double as score
          from patients where patientunitstayid % 3 = 0
          union all
          select patientunitstayid, (patientunitstayid * 29) % 1000 / 1000.0::double
          from patients where patientunitstayid % 6 = 0),
        b as (select patientunitstayid, max(score) as score from s group by patientunitstayid)
        select patientunitstayid, coalesce(b.score, ml_risk_score) as ml_risk_score,
          case when b.score is not null then cast(b.score > 0.5 as integer) end as ml_prediction
        from patients left join b using (patientunitstayid)""",
    "score_update": """
        select patientunitstayid, case when scored then (patientunitstayid * 13) % 1000 / 1000.0::double
            else ml_risk_score end as ml_risk_score,
          case when scored then cast((patientunitstayid * 13) % 1000 > 500 as integer) end
            as ml_prediction
        from (select *, (patientunitstayid // 100) % 3 = 1 and patientunitstayid % 4 = 0 as scored
              from patients)""",
    "stratified_split": """
        select patientunitstayid, hospital_mortality, apachescore, place < ceil(0.2 * n) as is_test
        from (select *, row_number() over (partition by hospital_mortality order by
                md5(concat_ws('|', patientunitstayid, '42')), patientunitstayid,
                apachescore asc nulls first) - 1 as place,
                count(*) over (partition by hospital_mortality) as n from scored)""",
}

# The same answers from other layouts.
QUERIES |= {
    "batch_build": QUERIES["patient_summary"],
    "cached_labs": QUERIES["clean_labs"],
    "feature_table_bucketed": QUERIES["feature_table"],
    "forecast_bucketed": QUERIES["forecast"],
}

# Result columns that the catalogue rounds: those of type double, but for the times.
DIGITS, NUDGE = 9, "3e-11::double"
DOUBLES = [
    "age", "admissionheight", "admissionweight", "ml_risk_score", "apachescore",
    "predictedhospitalmortality", "heartrate", "respiration", "sao2",
    "systemicsystolic", "systemicdiastolic", "temperature", "cvp", "labresultoffset", "labresult",
    "diagnosisoffset", "treatmentoffset", "Offset (min)", "hr_mean", "hr_std", "sao2_mean",
    "sao2_min", "resp_mean", "sbp_mean", "dbp_mean", "temp_mean", "lab_creatinine",
    "lab_glucose", "lab_hemoglobin", "lab_lactate", "lab_potassium", "lab_sodium", "lab_wbc",
    "mortality_rate", "avg_age", "avg_apache_score", "mortality_pct", "avg_apache", "share",
    "mean", "min", "max", "q1", "median", "q3", "lower_whisker", "upper_whisker", "value",
    "ewm", "std10", "trend", "lower", "upper", "gender_enc", "unittype_enc", "weight",
    "auc", "precision", "recall", "f1", "positive_rate", "risk_score", "importance", "lo", "hi",
]
# Queries whose results have none of them.
NO_DOUBLES = {
    "patient_count", "top_diagnoses", "diagnosis_labels", "lab_top_k", "search_totals",
    "future_offsets",
}
ALL_DOUBLES = {"auc", "auc_tied"}


def _needed(text: str, found: dict[str, str]) -> dict[str, str]:
    """Parts named in ``text``, each after the parts it names itself."""
    for name, body in PARTS.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            found[name] = body
    return found


def _sql(name: str, text: str) -> str:
    """The query with its parts, and the doubles of its result rounded."""
    listed = ", ".join(f"'{c}'" for c in DOUBLES)
    doubles = f"round(columns(lambda c: c in ({listed})) + {NUDGE}, {DIGITS})"
    others = f"columns(lambda c: c not in ({listed}))"
    if name in NO_DOUBLES:
        shown = "*"
    else:
        shown = doubles if name in ALL_DOUBLES else f"{others}, {doubles}"
    parts = "".join(f"{n} as ({b}),\n" for n, b in _needed(text, {}).items())
    return f"with {parts}result as ({text})\nselect {shown} from result"


ORACLE: dict[str, str] = {name: _sql(name, text) for name, text in QUERIES.items()}
