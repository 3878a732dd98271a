"""Cleaning and unpivoting of the wide table: expressions of bounded size, odd values."""

import tempfile

from hubflow.functions.columns import raw_columns
from hubflow.operators.clean import clean_wide
from hubflow.operators.journeys import unpivot_long

NUMBERS = {"?": 0, "12": 12, " 7 ": 7, "1e2": 100, "3.9": 3, "-4.5": -4, "nan": 0, "NaN": 0, "x": 0, "": 0, None: 0}


def _raw(spark, rows):
    cols = raw_columns()
    return spark.createDataFrame([[r.get(c, "?") for c in cols] for r in rows],
                                 ", ".join(f"{c} string" for c in cols))


def test_odd_values(spark):
    ids = {"?": "0", None: "0", "nan": "0", "a?b": "a0b", "5.0": "5.0"}
    rows = [{"nr": str(i), "o_rcs_p": v, "i2_dlv_e": v, "o_legid": w}
            for i, (v, w) in enumerate((v, w) for v in NUMBERS for w in ids)]
    got = {int(r["All_process_ID"]): r for r in clean_wide(_raw(spark, rows)).collect()}
    for i, r in enumerate(rows):
        assert got[i]["OUT_CheckIn_Planned_Mins"] == NUMBERS[r["o_rcs_p"]]
        assert got[i]["IN_2_Delivery_Effective_Mins"] == NUMBERS[r["i2_dlv_e"]]
        assert got[i]["OUT_Leg_ID"] == ids[r["o_legid"]]
        assert got[i]["IN_1_CheckIn_Planned_Mins"] == "?"          # no number in the column: text


def test_a_leg_reads_its_own_columns_once(spark):
    path = tempfile.mkdtemp() + "/wide"
    rows = [{"nr": "1", **{c: str(k + 1) for k, c in enumerate(raw_columns()[2:])}}]
    _raw(spark, rows).write.parquet(path)
    raw = spark.read.parquet(path)
    long = unpivot_long(clean_wide(raw))
    assert long.count() == 32
    scans = long._jdf.queryExecution().sparkPlan().collectLeaves()
    read = [scans.apply(i).output().size() for i in range(scans.size())]
    assert len(read) == 4 and max(read) < 25 and sum(read) <= len(raw.columns)
