"""The public names of a run's settings, their defaults, and the Config field each one sets.

A setting without a field says how one machine is to be used (device, memory, chunks, samples) or which results to show; the first is left to
Spark's partitions, the second to what the caller reads. They are accepted and have no effect on results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names and defaults that saved settings carry, so that they can be loaded as they are; then the field of Config.
SETTINGS = (
    ("remove_edges", False, "remove_edges"),
    ("remove_intermediates", False, None),
    ("voxel_reassign", True, "reassign"),
    ("analyze_node_level", True, "nodes"),
    ("track_all_frames", True, None),
    ("subsample_voxels", True, None),
    ("skip_vox", 5, None),
    ("preprocessing_num_t", None, "filter_frames"),
    ("preprocessing_min_radius_um", 0.25, "least_radius"),
    ("preprocessing_max_radius_um", 1.0, "most_radius"),
    ("preprocessing_alpha_sq", 0.5, "alpha_sq"),
    ("preprocessing_beta_sq", 0.5, "beta_sq"),
    ("preprocessing_frob_thresh", None, "frobenius_threshold"),
    ("preprocessing_frob_thresh_division", 2, "frobenius_division"),
    ("preprocessing_device", "auto", None),
    ("preprocessing_low_memory", False, None),
    ("preprocessing_max_chunk_voxels", 1_000_000, None),
    ("preprocessing_max_threshold_samples", 1_000_000, None),
    ("segmentation_label_num_t", None, "label_frames"),
    ("segmentation_label_threshold", None, "threshold"),
    ("segmentation_label_otsu_thresh_intensity", False, "intensity_otsu"),
    ("segmentation_label_chunk_z", None, None),
    ("segmentation_label_flush_interval", 1, None),
    ("segmentation_label_min_radius_um", 0.25, "label_radius"),
    ("segmentation_label_threshold_sampling_pixels", 1_000_000, None),
    ("segmentation_label_histogram_nbins", 256, "bins"),
    ("segmentation_label_device", "auto", None),
    ("segmentation_label_low_memory", False, None),
    ("segmentation_label_max_chunk_voxels", 1_000_000, None),
    ("segmentation_network_num_t", None, "network_frames"),
    ("segmentation_network_min_radius_um", 0.2, None),
    ("segmentation_network_max_radius_um", 1.0, None),
    ("segmentation_network_device", "auto", None),
    ("segmentation_network_low_memory", False, None),
    ("segmentation_network_max_chunk_voxels", 1_000_000, None),
    ("mocap_num_t", None, "marker_frames"),
    ("mocap_min_radius_um", 0.2, "least_marker_radius"),
    ("mocap_max_radius_um", 1.0, "most_marker_radius"),
    ("mocap_use_im", "distance", "peaks_from"),
    ("mocap_num_sigma", 5, "scales"),
    ("mocap_prefer_gpu", True, None),
    ("mocap_peak_min_distance", 2, "peak_distance"),
    ("mocap_device", "auto", None),
    ("mocap_low_memory", False, None),
    ("mocap_max_chunk_voxels", 1_000_000, None),
    ("tracking_num_t", None, "track_frames"),
    ("tracking_max_distance_um", 1.0, "most_speed"),
    ("tracking_device", "auto", None),
    ("tracking_mode", "auto", None),
    ("tracking_max_dense_pairs", 10_000_000, None),
    ("tracking_max_dense_roi_voxels_cpu", 50_000_000, None),
    ("tracking_max_dense_roi_voxels_gpu", 20_000_000, None),
    ("tracking_low_memory", False, None),
    ("reassign_num_t", None, "reassign_frames"),
    ("reassign_store_running_matches", True, None),
    ("reassign_max_refine_iterations", 3, None),
    ("reassign_device", "auto", None),
    ("reassign_low_memory", False, None),
    ("reassign_max_query_points", 1_000_000, None),
    ("reassign_max_bruteforce_pairs", 10_000_000, None),
    ("feature_skip_nodes", None, None),
    ("feature_use_gpu", True, None),
    ("feature_low_memory", False, None),
    ("feature_enable_motility", True, "motility"),
    ("feature_enable_adjacency", True, "adjacency"),
    ("feature_device", "auto", None),
    ("feature_node_chunk_size", None, None),
    ("feature_max_node_mask_elems", 50_000_000, None),
)
FIELDS = {name: field for name, _, field in SETTINGS}


def table(spark: SparkSession) -> DataFrame:
    """name, value (the default as text), field of every setting."""
    return spark.createDataFrame([(n, None if v is None else str(v), f) for n, v, f in SETTINGS], "name string, value string, field string")
