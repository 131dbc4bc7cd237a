"""Input views over the driver tables.

Each view is a deterministic projection whose expressions run unchanged in Spark
and in DuckDB. They are written once here: the Spark side selects them with the
DataFrame API and the oracle side prints them as a sub-query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from assaymill.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class View:
    source: str
    columns: dict[str, str]
    joins: tuple[tuple[str, str], ...] = ()
    where: str | None = None
    parent: "View | None" = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.parent.frame(spark, sf_dir) if self.parent else table(spark, sf_dir, self.source)
        for name, condition in self.joins:
            other = table(spark, sf_dir, name)
            left, right = (side.strip() for side in condition.split("="))
            df = df.join(other, df[left] == other[right])
        return self.over(df)

    def over(self, df: DataFrame) -> DataFrame:
        """The projection on a given source, also a streaming one."""
        if self.where:
            df = df.where(self.where)
        return df.selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    def sql(self) -> str:
        body = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        source = f"({self.parent.sql()})" if self.parent else self.source
        joins = "".join(f" JOIN {name} ON {condition}" for name, condition in self.joins)
        where = f" WHERE {self.where}" if self.where else ""
        # DuckDB reads list elements with another function name, also from 1.
        return f"SELECT {body} FROM {source}{joins}{where}".replace("element_at(", "list_extract(")


# Truth on a 5..18 scale, a prediction with planted bias, and the audit columns.
_SCORED = View(
    source="lineitem",
    joins=(
        ("supplier", "l_suppkey = s_suppkey"),
        ("nation", "s_nationkey = n_nationkey"),
        ("region", "n_regionkey = r_regionkey"),
    ),
    columns={
        "id": "concat_ws('-', cast(l_orderkey as string), cast(l_partkey as string),"
        " cast(l_suppkey as string), cast(l_linenumber as string))",
        "l_orderkey": "l_orderkey",
        "l_partkey": "l_partkey",
        "l_suppkey": "l_suppkey",
        "y_true": "floor((5 + 13 * (l_quantity - 1) / 49) * 100 + cast(0.5 as double)) / 100",
        "ita": "cast((l_suppkey * 37) % 121 - 45 as double)",
        "noise": "(l_discount - cast(0.05 as double)) * 20 + cast((l_partkey % 21) - 10 as double) / 10",
        "sex": "case when l_linestatus = 'O' then 'M' else 'F' end",
        "site": "r_name",
        "sigma": "cast(0.3 as double) + cast(l_partkey % 97 as double) / 97",
    },
)
_PREDICTED = View(
    source="",
    parent=_SCORED,
    columns={
        "id": "id",
        "l_orderkey": "l_orderkey",
        "l_suppkey": "l_suppkey",
        "y_true": "y_true",
        "ita": "ita",
        "y_pred": "case when l_orderkey % 50 = 0 then null"
        " else y_true + noise + cast(0.004 as double) * ita end",
        "sex": "sex",
        "site": "site",
        "sigma": "sigma",
    },
)
PRED = View(
    source="",
    parent=_PREDICTED,
    columns={
        "id": "id",
        "head": "case when l_orderkey % 3 = 0 then 'ordinal' when l_orderkey % 3 = 1"
        " then 'regression' else 'severity' end",
        "l_suppkey": "l_suppkey",
        "y_true": "y_true",
        "y_pred": "y_pred",
        "ita": "ita",
        "sex": "sex",
        "site": "site",
        "sigma": "sigma",
        "confidence": "case when y_pred is null then null else greatest(cast(0.05 as double),"
        " least(cast(0.95 as double), 1 - abs(y_pred - y_true) / 4"
        " + cast((l_orderkey % 11) - 5 as double) / 50)) end",
    },
)

# Twelve class scores per vector, a class label, and a fixed split by id.
LOGITS = View(
    source="embeddings",
    columns={
        "id": "vec_id",
        "target": "label",
        "split": "case when vec_id % 5 = 0 then 'test' when vec_id % 5 = 1 then 'val' else 'train' end",
        "y_true": "12 + 3 * cast(element_at(embedding, 15) as double)",
        "y_pred": "12 + 3 * cast(element_at(embedding, 16) as double)",
        "sex": "case when vec_id % 2 = 0 then 'M' else 'F' end",
        **{f"z{i}": f"8 * cast(element_at(embedding, {i}) as double)" for i in range(1, 13)},
    },
)

# Thirteen feature columns with labels.
FEATURES = View(
    source="embeddings",
    columns={
        "id": "vec_id",
        "site": "case when vec_id % 5 < 2 then 'north' else 'south' end",
        "sex": "case when vec_id % 2 = 0 then 'M' else 'F' end",
        "split": "case when vec_id % 5 = 0 then 'test' when vec_id % 5 = 1 then 'val' else 'train' end",
        "y": "12 + 3 * cast(element_at(embedding, 14) as double)"
        " + 2 * cast(element_at(embedding, 1) as double) - cast(element_at(embedding, 2) as double)",
        **{
            f"f{i}": f"cast(element_at(embedding, {i}) as double)"
            if i not in (5, 11)
            else (
                "case when vec_id % 7 = 3 then null else cast(element_at(embedding, 5) as double) end"
                if i == 5
                else "cast(1.5 as double)"
            )
            for i in range(1, 14)
        },
    },
)

# Patients: site-qualified id, value, sex, age; some values fall outside the range.
PATIENTS = View(
    source="customer",
    joins=(("nation", "c_nationkey = n_nationkey"),),
    columns={
        "patient_id": "concat(n_name, '/', cast(c_custkey as string))",
        "site": "n_name",
        "key": "c_custkey",
        "value": "round(3 + abs(c_acctbal) % 17, 2)",
        "sex": "case when c_custkey % 2 = 0 then 'M' when c_custkey % 7 = 1 then 'unknown' else 'F' end",
        "age": "case when c_custkey % 11 = 0 then null else cast(c_custkey % 80 + 5 as double) end",
    },
)

# An all-text label sheet with the dirt people leave in one.
LABELS = View(
    source="customer",
    columns={
        "patient_id": "case when floor(c_custkey / 11) % 13 = 5 then concat('A', cast(floor(c_custkey / 11) as int))"
        " when c_custkey % 3 = 0 then concat('00', cast(cast(floor(c_custkey / 11) as int) as string))"
        " else concat(' ', cast(cast(floor(c_custkey / 11) as int) as string), ' ') end",
        "hb": "case c_custkey % 19 when 0 then '13,7' when 1 then '  12,4 ' when 2 then '_' when 3 then 'n/a'"
        " when 4 then '1,234' when 5 then '13.7,1' when 6 then 'Not available' when 7 then null when 8 then '45.5'"
        " when 9 then '15' when 10 then 'NaN' when 11 then '-' else cast(round(8 + c_custkey % 90 / 10.0e0, 1) as string) end",
        "sex": "case c_custkey % 6 when 0 then 'Male' when 1 then 'f' when 2 then ' FEMALE' when 3 then 'm.' when 4 then '?'"
        " else null end",
        "age": "case c_custkey % 10 when 0 then 'unknown' when 1 then null when 2 then '1e400' else"
        " cast(20 + c_custkey % 60 as string) end",
        "site": "case when c_mktsegment < 'C' then 'india (north)' when c_mktsegment < 'G' then 'ITALY'"
        " when c_mktsegment < 'I' then 'Italia' when c_mktsegment < 'N' then ' INDIA' else 'clinic' end",
        "note": "case when c_custkey % 23 = 0 then ' checked twice ' when c_custkey % 37 = 0 then 'to be Removed' else null end",
        "flag": "case when c_custkey % 41 = 0 then 'ELIMINATO' when c_custkey % 53 = 0 then 'drop, see note' else null end",
        "row_pos": "c_custkey",
    },
)

# A file listing: eight files per patient folder, with copies and misspellings.
FILES = View(
    source="part",
    columns={
        "site": "case when floor(p_partkey / 8) % 2 = 0 then 'India' else 'Italy' end",
        "folder": "case when floor(p_partkey / 8) % 5 = 0"
        " then concat('0', cast(cast(floor(p_partkey / 16) as int) as string))"
        " else cast(cast(floor(p_partkey / 16) as int) as string) end",
        "name": "case when floor(p_partkey / 8) % 17 = 3 then concat('notes_', cast(p_partkey % 8 as string), '.txt')"
        " when floor(p_partkey / 8) % 11 = 4 and p_partkey % 8 in (0, 5) then 'Thumbs.db'"
        " when floor(p_partkey / 8) % 7 = 2 and p_partkey % 8 in (3, 4, 6) then concat('scan_', cast(p_size as string), '.PNG')"
        " else case p_partkey % 8 when 0 then '20200118_164733.jpg' when 1 then '20200118_164733_forniceal.png'"
        " when 2 then '20200118_164733_forniceal_palpebral.png' when 3 then '20200124_202947_palpebral.png'"
        " when 4 then '20200124_202947_palpebral(1).png' when 5 then '1.jpg'"
        " when 6 then 'T_64_20190612_092742_palplebral.png' else 'T_64_20190612_092742_forniceal_palplebral.png' end end",
        "length": "cast(1000 + p_size as bigint)",
    },
)
LISTING = View(
    source="",
    parent=FILES,
    columns={
        "site": "site",
        "folder": "folder",
        "name": "name",
        "length": "length",
        "path": "concat(site, '/', folder, '/', name)",
    },
)

# Pixels of one image per supplier; some images have no mask at all.
PIXELS = View(
    source="lineitem",
    columns={
        "image_id": "l_suppkey",
        "r": "cast(l_partkey % 256 as int)",
        "g": "cast(l_orderkey % 256 as int)",
        "b": "cast(l_quantity as int) * 5",
        "in_roi": "case when l_suppkey % 10 = 7 then null else l_linenumber <= 4 and l_suppkey % 10 <> 3 end",
    },
)

# Images of 50 by 40 pixels with positions.
GRID = View(
    source="part",
    columns={
        "image_id": "cast(floor(p_partkey / 2000) as bigint)",
        "x": "cast(p_partkey % 50 as int)",
        "y": "cast(floor(p_partkey / 50) % 40 as int)",
        "r": "cast(cast(floor(p_retailprice) as bigint) % 256 as int)",
        "g": "cast((p_partkey * 7) % 256 as int)",
        "b": "cast(p_size * 5 as int)",
        "in_roi": "p_partkey % 50 between 12 and 30 and floor(p_partkey / 50) % 40 between 9 and 25",
    },
)

# Masks of 25 by 20 pixels for the same images.
MASK_GRID = View(
    source="part",
    where="p_partkey % 2000 < 500",
    columns={
        "image_id": "cast(floor(p_partkey / 2000) as bigint)",
        "mx": "cast(p_partkey % 25 as int)",
        "my": "cast(floor((p_partkey % 2000) / 25) as int)",
        "mask_on": "p_size > 20",
    },
)

# Measured photographs.
QUALITY = View(
    source="documents",
    columns={
        "doc_id": "doc_id",
        "lang": "lang",
        "luma": "cast(30 + n_chars % 211 as double)",
        "clipped": "cast(n_chars % 23 as double) / 1000",
        "sharpness": "cast(n_chars % 997 as double) * cast(0.8 as double)",
        "roi_area": "case when doc_id % 9 = 0 then null else cast(n_chars % 101 as double) / 100 end",
        "height": "case when doc_id % 50 = 49 then -1 when n_chars % 5 = 0 then 3984 else 2984 end",
        "width": "case when doc_id % 50 = 49 then -1 when n_chars % 5 = 0 then 2984 else 3984 end",
    },
)

# Telemetry requests: a key, an arrival time and fields, some of them invalid.
TELEMETRY = View(
    source="events",
    columns={
        "event_id": "event_id",
        "ts": "ts",
        "key": "cast(user_id as string)",
        "model_id": "case when event_id % 41 = 0 then 'Bad Model!' when event_id % 43 = 0 then ''"
        " when event_id % 97 = 0 then repeat('m', 70) else concat('model-', cast(event_id % 3 as string), '.v1') end",
        "band": "case when event_id % 29 = 0 then 'fine' when event_type = 'view' then 'within_range'"
        " when event_type = 'click' then 'mild' when event_type = 'purchase' then 'moderate'"
        " when event_type = 'error' then 'severe' else 'abstained' end",
        "hb_hat": "case when event_id % 13 = 0 then null else floor((3 + value / 6) * 10) / 10 end",
        "sigma": "case when event_id % 17 = 0 then null else floor(value / 2) / 10 end",
        "quality": "case when event_id % 19 = 0 then null else cast(event_id % 103 as double) / 100 end",
        "latency_ms": "case when event_id % 23 = 0 then null when event_id % 31 = 0 then cast(12.5 as double)"
        " else cast((event_id * 7) % 61000 as double) end",
        "lab": "floor(value / 8 * 10) / 10",
        "props": "props",
    },
)
BODIES = View(
    source="",
    parent=TELEMETRY,
    columns={
        "event_id": "event_id",
        "ts": "ts",
        "key": "key",
        "lab": "lab",
        "body": "case event_id % 50 when 1 then '{\"a\":' when 2 then '[1, 2]' when 3 then 'null' when 4 then '\"text\"'"
        " when 5 then concat('{\"pad\":\"', repeat('x', 1100), '\"}') when 6 then concat('{\"pad\":\"', repeat('\u00e9', 600), '\"}')"
        " when 7 then '{\"model_id\":\"m\",\"band\":\"mild\",\"hb_hat\":\"12\"}'"
        " when 8 then '{\"model_id\":7,\"band\":\"mild\"}' when 9 then '{\"model_id\":\"m\",\"band\":\"mild\",\"sigma\":null}'"
        " else concat('{\"model_id\":\"', model_id, '\",\"band\":\"', band, '\"',"
        " case when hb_hat is null then '' else concat(',\"hb_hat\":', cast(hb_hat as string)) end,"
        " case when sigma is null then '' else concat(',\"sigma\":', cast(sigma as string)) end,"
        " case when quality is null then '' else concat(',\"quality\":', cast(quality as string)) end,"
        " case when latency_ms is null then '' when latency_ms = 12.5 then ',\"latency_ms\":12.5'"
        " else concat(',\"latency_ms\":', cast(cast(latency_ms as bigint) as string)) end,"
        " ',\"extra\":', props, '}') end",
    },
)
# Feedback requests: a laboratory value, some bodies of another shape or type.
FEEDBACK = View(
    source="",
    parent=TELEMETRY,
    columns={
        "event_id": "event_id",
        "ts": "ts",
        "key": "key",
        "body": "case event_id % 40 when 1 then '{\"hb\":' when 2 then '[12.5]' when 3 then '{\"hb\":\"12.5\"}' when 4 then '{\"hb\":null}'"
        " when 5 then concat('{\"pad\":\"', repeat('x', 1100), '\"}') when 6 then '{\"value\":12.5}'"
        " else concat('{\"hb\":', cast(lab as string), ',\"comment\":\"dropped\"}') end",
    },
)
