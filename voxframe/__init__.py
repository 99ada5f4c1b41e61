"""voxframe: segmented, time-resolved image analytics as Spark DataFrames."""
