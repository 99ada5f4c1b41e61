"""Tables of rows are shuffled, however small their files are: none is gathered in the driver."""

from voxframe import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_rows_are_shuffled(spark):
    for name in ("jon_21_label_pair_counts", "jon_18_labelled_candidates", "agg_33_weighted_vote", "opr_5_track_markers"):
        left = [line for line in plan(registry.queries()[name](spark, SF)).splitlines() if "BroadcastHashJoin" in line]
        # the sums of a frame are the one table that may be sent: a row for each frame
        assert all("[t#" in line and "], Inner" in line and line.count("#") <= 4 for line in left), (name, left)
