"""The public verbs of the engine and their settings: frames in, tables out."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions import moments, thresholds
from voxframe.operators import features, kernels, network, regions, spatial, stats, stencil, tracking
from voxframe.plans.session import checkpointed, drop
from voxframe.sources.metadata import sigma_ladder
from voxframe.sources.stages import FEATURES, StageStore


@dataclass(frozen=True)
class Config:
    """Settings of a run; lengths in micrometres, times in seconds. depth 0 means frames without a z axis.

    keys name a frame: ("t",), or ("image_id", "t") for many images of one layout in the same tables. The last one is the frame's number.
    """

    keys: tuple[str, ...] = ("t",)
    spacing_z: float = 1.0
    spacing_y: float = 1.0
    spacing_x: float = 1.0
    dt: float = 1.0
    depth: int = 0
    height: int = 8
    width: int = 8
    # filter
    least_radius: float = 0.25
    most_radius: float = 1.0
    bins: int = 256
    alpha_sq: float = 0.5
    beta_sq: float = 0.5
    frobenius_threshold: float | None = None
    frobenius_division: float = 2.0
    remove_edges: bool = False
    edge_margin: int = 15
    # label
    threshold: float | None = None
    intensity_otsu: bool = False
    label_radius: float = 0.25
    least_object: int | None = None  # cells; None: those of a disc or ball of label_radius
    smooth_mask: bool = True
    tile: int | None = None  # cells along each axis; frames beyond a task's memory are labelled in tiles
    # markers
    least_marker_radius: float = 0.2
    most_marker_radius: float = 1.0
    peaks_from: str = "distance"
    scales: int = 5
    peak_distance: int = 2
    # track, reassign
    most_speed: float = 1.0
    match_speed: float = 0.5
    most_cost: float = 1.0
    reassign: bool = True
    # frames of each image that a verb takes, counted by t from 0; None: all
    filter_frames: int | None = None
    label_frames: int | None = None
    network_frames: int | None = None
    marker_frames: int | None = None
    track_frames: int | None = None
    reassign_frames: int | None = None
    # features
    nodes: bool = True
    motility: bool = True
    adjacency: bool = True

    @property
    def axes(self) -> tuple[str, ...]:
        return ("z", "y", "x") if self.depth else ("y", "x")

    @property
    def shape(self) -> dict[str, int]:
        return {a: n for a, n in (("z", self.depth), ("y", self.height), ("x", self.width)) if a in self.axes}

    @property
    def spacing(self) -> tuple[float, ...]:
        return tuple(getattr(self, f"spacing_{a}") for a in self.axes)

    @property
    def sigmas(self) -> tuple[float, ...]:
        """Scales of the filter, in cells."""
        return tuple(sigma_ladder(self.least_radius / self.spacing_x, self.most_radius / self.spacing_x))

    @property
    def marker_sigmas(self) -> tuple[float, ...]:
        return tuple(sigma_ladder(self.least_marker_radius / self.spacing_x, self.most_marker_radius / self.spacing_x, self.scales))

    @property
    def least_cells(self) -> int:
        """Cells of the smallest object that stays."""
        if self.least_object is not None:
            return self.least_object
        r = max(self.label_radius, self.spacing_x)
        volume = 4 / 3 * math.pi * r**3 if self.depth else math.pi * r * r
        return max(1, math.ceil(volume / math.prod(self.spacing)))

    @property
    def z_ratio(self) -> float:
        """Sigma along z over sigma along x."""
        return self.spacing_x / self.spacing_z

    @property
    def reach(self) -> float:
        """Cells beyond which distances to the background count as equal."""
        return max(1.0, 2 * self.most_marker_radius / self.spacing_x)

    @property
    def gate(self) -> float:
        return max(self.most_speed * self.dt, 0.5)

    @property
    def match_gate(self) -> float:
        return max(self.match_speed * self.dt, 0.5)

    @classmethod
    def from_settings(cls, settings: dict, **layout) -> Config:
        """The Config of saved settings by their public names (see plans.settings); those that leave the plan to Spark have no field."""
        from voxframe.plans.settings import FIELDS

        known = {f.name for f in fields(cls)}
        given = {FIELDS[k]: v for k, v in settings.items() if FIELDS.get(k) in known and v is not None}
        if given.get("peaks_from") not in (None, "distance"):
            given["peaks_from"] = "vesselness"
        if settings.get("feature_skip_nodes") is not None:
            given["nodes"] = not settings["feature_skip_nodes"]
        return cls(**(given | layout))


#: The stage table of each table of a run.
STAGE_OF = {
    "vesselness": "vesselness", "labels": "labels", "skeleton": "skeleton", "branches": "features_branches", "border": "border", "markers": "markers", "flow": "flow", "matches": "voxel_matches",
    "reassigned_organelles": "reassigned", "edges": "edges", "voxels": "features_voxels", "nodes": "features_nodes", "organelles": "features_organelles", "image": "features_image",
}


class Engine:
    """Each verb takes and returns DataFrames over (frame, axes), where the frame is Config.keys: t, or image and t.

    Frames are independent up to tracking, which joins frames of one image; a run over many images takes as many Spark jobs as one over the longest.
    With Config.tile the kernels work on tiles of that many cells along each axis with the halo each of them needs; thresholds stay those of whole frames.
    """

    def __init__(self, config: Config = Config()):
        self.config = config
        self.frame = list(config.keys)
        self.tiling = kernels.Tiling(config.tile, config.shape) if config.tile else None

    def _first(self, df: DataFrame, frames: int | None) -> DataFrame:
        return df if frames is None else df.where(F.col("t") < frames)

    def ordinal(self) -> Column:
        """The place of a cell in its frame's scan order."""
        out = F.lit(0).cast("long")
        for a, n in self.config.shape.items():
            out = out * n + F.col(a)
        return out

    def vesselness(self, frames: DataFrame) -> DataFrame:
        """frame, axes, v: the greatest tube response over all scales where every scale's Hessian is strong, cleaned by its own mask.

        One kernel makes all scales, their Hessians and eigenvalues from a dense frame or tile; what it finds goes through no other exchange
        before the thresholds, which are of whole frames. In 2D bright blobs count as well.
        """
        c, axes, f = self.config, self.config.axes, self.frame
        frames = self._first(frames, c.filter_frames)
        kernel, scales = kernels.TubeSpace(kernels.ScaleSpace(c.sigmas, c.z_ratio), c.spacing), range(len(c.sigmas))
        space = checkpointed(kernels.frame_kernel(frames, f, "v", kernel, axes, kernel.outputs(), self.tiling))
        tops = checkpointed(space.groupBy(*f).agg(*[F.max(f"{n}_{k}").alias(f"{n}_top_{k}") for n in ("part", "norm") for k in scales]))
        share = lambda k, n: F.when(F.col(f"part_top_{k}") > 0, F.col(n) / F.col(f"part_top_{k}")).otherwise(0.0)
        topped = space.join(tops, f)
        each = topped.select(*f, F.posexplode(F.array(*[F.struct(F.col(f"v_{k}").alias("v"), share(k, f"norm_{k}").alias("norm")) for k in scales])).alias("k", "x")).select(*f, "k", "x.*")
        limits = thresholds.gamma(each, [*f, "k"], "v", c.bins)
        if not c.frobenius_division:
            limits = limits.withColumn("bar", F.lit(0.0))
        elif c.frobenius_threshold is not None:
            limits = limits.withColumn("bar", F.lit(c.frobenius_threshold / c.frobenius_division))
        else:
            bar = thresholds.smaller_of_both(each.where("norm > 0"), [*f, "k"], "norm", c.bins).select(*f, "k", (F.col("threshold") / c.frobenius_division).alias("bar"))
            limits = limits.join(bar, [*f, "k"], "left").fillna(0.0, ["bar"])
        limits = checkpointed(limits.groupBy(*f).agg(*[F.max(F.when(F.col("k") == k, F.col(n))).alias(f"{n}_{k}") for n in ("gamma", "bar") for k in scales]))
        rated = {k: F.coalesce(share(k, f"norm_top_{k}") > F.col(f"bar_{k}"), F.lit(False)) for k in scales}  # a scale whose mask is empty has no say
        strong = {k: F.coalesce(share(k, f"norm_{k}") > F.col(f"bar_{k}"), F.lit(False)) for k in scales}
        on, best = F.lit(True), F.lit(0.0)
        for k in scales:
            two_gamma_sq, eigen = 2 * F.col(f"gamma_{k}") * F.col(f"gamma_{k}"), [F.col(f"l{i + 1}_{k}") for i in range(len(axes))]
            response = stencil.vesselness_3d(*eigen, two_gamma_sq, c.alpha_sq, c.beta_sq) if c.depth else stencil.vesselness_2d(*eigen, two_gamma_sq, c.beta_sq)
            on, best = on & (~rated[k] | strong[k]), F.greatest(best, F.when(rated[k] & strong[k], response).otherwise(0.0))
        out = topped.join(limits, f, "left").select(*f, *axes, F.when(on, best).otherwise(0.0).alias("v"), F.when(on, F.greatest("blob", F.lit(0.0))).otherwise(0.0).alias("blob"))
        out = checkpointed(out)
        drop(space, tops, limits)
        if not c.depth:
            top = out.groupBy(*f).agg(F.max("blob").alias("top"))
            out = out.join(top, f).withColumn("v", F.greatest("v", F.col("blob") / (F.col("top") + 1e-12) / 10))
        out = checkpointed(out.select(*f, *axes, "v"))
        if c.remove_edges:
            out = stencil.cut_edges(out, [*f, "z"] if c.depth else f, "v", c.edge_margin)
        faint = out.groupBy(*f).agg(F.percentile(F.when(F.col("v") > 0, F.col("v")), 0.01).alias("faint"))
        clear = out.join(faint, f).select(*f, *axes, F.when(F.col("v") > F.col("faint"), F.col("v")).otherwise(0.0).alias("v"))
        return kernels.frame_kernel(clear, f, "v", kernels.Opening(), axes, tiling=self.tiling)

    def components(self, mask: DataFrame) -> DataFrame:
        axes, f = list(self.config.axes), self.frame
        return regions.components_tiled(mask, f, axes, self.config.tile) if self.config.tile else regions.components(mask, f, axes)

    def label(self, vesselness: DataFrame, intensity: DataFrame | None = None) -> DataFrame:
        """t, axes, label of the components of dense frames above the threshold (the frame's own if the settings give none).

        In 3D holes are filled; small components go, what is left is smoothed by a mean filter and labelled anew.
        """
        c, axes, f = self.config, self.config.axes, self.frame
        frames = vesselness = self._first(vesselness, c.label_frames)
        if c.intensity_otsu and intensity is not None:
            bar = thresholds.otsu(intensity.where("v != 0"), f, "v", c.bins).withColumnRenamed("threshold", "least")
            bright = intensity.join(bar, f).where("v > least").select(*f, *axes, F.lit(True).alias("bright"))
            frames = frames.join(bright, [*f, *axes], "left").withColumn("v", F.when(F.col("bright"), F.col("v")).otherwise(0.0)).drop("bright")
        if c.threshold is None:
            bar = thresholds.log_threshold(frames, f, "v", c.bins)
            mask = frames.join(bar, f, "left").withColumn("v", F.coalesce(F.col("v") > F.col("threshold"), F.lit(False)).cast("double")).select(*f, *axes, "v")
        else:
            mask = frames.withColumn("v", (F.col("v") > c.threshold).cast("double")).select(*f, *axes, "v")
        if c.depth:
            mask = kernels.frame_kernel(mask, f, "v", kernels.FillHoles(), axes)
        mask = checkpointed(mask)
        found = regions.keep_large(self.components(mask.where("v > 0").select(*f, *axes)), [*f, "label"], c.least_cells)
        if not c.smooth_mask:
            return found
        on = mask.select(*f, *axes).join(found.select(*f, *axes, F.lit(1.0).alias("v")), [*f, *axes], "left").fillna(0.0, ["v"])
        smooth = kernels.frame_kernel(on, f, "v", kernels.MeanFilter(), axes, tiling=self.tiling)
        return self.components(smooth.where(F.round("v", 9) > 0.5).select(*f, *axes))

    def network(self, labels: DataFrame, vesselness: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Skeleton (t, axes, label, pixel_class, branch or null) and voxels with the branch they are nearest to.

        Skeleton cells that touch a second label go, unless at the image's edge; an object left without any gets its voxel of the
        greatest vesselness.
        """
        c, axes, f = self.config, self.config.axes, self.frame
        labels = self._first(labels, c.network_frames)
        thin = labels.join(kernels.thin(labels, f, axes, self.tiling), [*f, *axes], "left_semi").select(*f, *axes, "label")
        clean = stencil.unambiguous(thin, f, axes, "label", c.shape)
        valued = labels.join(vesselness, [*f, *axes])
        skeleton = checkpointed(network.add_missing_skeleton(valued, clean, f, "label", axes, "v"))
        branches = checkpointed(network.branch_labels(skeleton.select(*f, *axes), f, axes))
        graded = skeleton.join(stencil.pixel_class(skeleton, f, axes), [*f, *axes]).join(branches, [*f, *axes], "left")
        seeds = branches.join(labels, [*f, *axes]).select(*f, "label", *axes, "branch")
        return graded, network.nearest_seed(labels, seeds, [*f, "label"], axes, c.spacing, "branch")

    def distances(self, labels: DataFrame, frames: DataFrame) -> DataFrame:
        """t, axes, distance of each labelled voxel to the background, in cells."""
        c, axes, f = self.config, self.config.axes, self.frame
        on = frames.select(*f, *axes).join(labels.select(*f, *axes, F.lit(True).alias("on")), [*f, *axes], "left").withColumn("on", F.coalesce("on", F.lit(False)))
        return kernels.distance(on, f, "on", c.reach, axes, self.tiling).select(*f, *axes, "distance")

    def border(self, labels: DataFrame) -> DataFrame:
        return stencil.border(labels, self.frame, self.config.axes, self.config.shape)

    def markers(self, labels: DataFrame, intensity: DataFrame, vesselness: DataFrame) -> DataFrame:
        """t, id, axes, stats, hu: blob peaks of the distance (or vesselness) inside objects, the brightest within peak_distance kept,
        measured in boxes of twice their distance to the background."""
        c, axes, f = self.config, self.config.axes, self.frame
        labels, intensity = self._first(labels, c.marker_frames), self._first(intensity, c.marker_frames)
        far = checkpointed(self.distances(labels, intensity))
        if c.peaks_from == "distance":
            base = intensity.select(*f, *axes).join(far.withColumnRenamed("distance", "v"), [*f, *axes], "left").fillna(0.0, ["v"])
        elif c.peaks_from == "vesselness":
            base = vesselness
        else:
            raise ValueError(f"peaks come from the distance or the vesselness, not from {c.peaks_from!r}")
        spots = kernels.frame_kernel(base, f, "v", kernels.LogPeaks(c.marker_sigmas, c.z_ratio), axes, tiling=self.tiling).where("v > 0").select(*f, *axes)
        spots = spots.join(far.where("distance > 0"), [*f, *axes])
        bright = stencil.local_maxima(spots.join(intensity, [*f, *axes]), f, axes, "v", c.peak_distance)
        wide = stencil.neighbourhood(far, f, axes, [(2 * F.max("distance")).alias("radius")])
        marks = bright.join(wide, [*f, *axes]).select(*f, self.ordinal().alias("id"), *axes, F.ceil("radius").alias("r"))
        boxes = marks.select(*f, "id", *[F.greatest(F.col(a) - F.col("r"), F.lit(0)).alias(f"low_{a}") for a in axes], *[F.least(F.col(a) + F.col("r"), F.lit(n - 1)).alias(f"high_{a}") for a, n in c.shape.items()])
        cells = intensity.join(vesselness.withColumnRenamed("v", "structure"), [*f, *axes]).withColumn("v", F.greatest("v", F.lit(0.0)))
        inside = checkpointed(spatial.box_join(cells, boxes, f, axes, 8).select(*f, "id", *axes, "v", "structure"))
        level = moments.nonzero_stats(inside, [*f, "id"], "v").join(moments.nonzero_stats(inside, [*f, "id"], "structure").toDF(*f, "id", "s_mean", "s_variance"), [*f, "id"])
        views = ["z", "y", "x"] if c.depth else [""]
        if c.depth:
            shape = moments.log_hu_table(moments.projections(inside, [*f, "id"], "v"), [*f, "id", "axis"], "a", "b", "v")
        else:
            shape = moments.log_hu_table(inside, [*f, "id"], "y", "x", "v").withColumn("axis", F.lit(""))
        hu = [F.max(F.when(F.col("axis") == a, F.col(f"h{i}"))).alias(f"h{a}{i}") for a in views for i in range(1, 7)]
        shape = shape.groupBy(*f, "id").agg(*hu)
        both = marks.drop("r").join(shape, [*f, "id"]).join(level, [*f, "id"])
        return both.select(*f, "id", *axes, F.array("mean", "variance", "s_mean", "s_variance").alias("stats"), F.array(*[f"h{a}{i}" for a in views for i in range(1, 7)]).alias("hu"))

    def physical(self, rows: DataFrame) -> DataFrame:
        """rows with their axes in micrometres."""
        return rows.withColumns({a: F.col(a) * F.lit(float(s)) for a, s in zip(self.config.axes, self.config.spacing, strict=True)})

    def track_markers(self, markers: DataFrame) -> DataFrame:
        """Flow rows between consecutive frames, in micrometres."""
        c, axes, f = self.config, self.config.axes, self.frame
        scaled = self.physical(self._first(markers, c.track_frames))
        sizes = (4, 18 if c.depth else 6)
        pairs = checkpointed(tracking.gated_pairs(scaled, axes, c.gate, "stats", "hu", f, sizes))  # read for the sums and for the rows
        costs = tracking.pair_costs(pairs, c.gate, *sizes, f)
        return tracking.flow_table(tracking.best_matches(costs, c.most_cost, frame=f), scaled, axes, f)

    def interpolate_flow(self, points: DataFrame, flow: DataFrame, forward: bool = True) -> DataFrame:
        return tracking.interpolate(points, flow, self.config.axes, self.config.match_gate, forward, self.frame)

    def matches(self, voxels: DataFrame, fw: DataFrame, bw: DataFrame) -> DataFrame:
        """Voxels (in micrometres) matched between consecutive frames, both ways."""
        return tracking.voxel_candidates(voxels, fw, bw, self.config.axes, self.config.match_gate, self.frame)

    def reassign(self, matches: DataFrame, labels: DataFrame) -> DataFrame:
        """New labels (frame, id, label), carried over from each image's first frame by matched voxels."""
        return tracking.reassign_chain(matches, self._first(labels, self.config.reassign_frames), frame=self.frame)

    def hierarchy(self, voxels: DataFrame, skeleton: DataFrame, distances: DataFrame, fw: DataFrame, bw: DataFrame) -> dict[str, DataFrame]:
        """Tables of all levels: voxels, nodes, branches, organelles, image, and edges between them.

        voxels: t, id, axes, label (organelle), branch, intensity, structure and, where labels were carried over, new_organelle and
        new_branch. Each level has the five statistics of the levels below it and its own raw features.
        """
        c, axes, f = self.config, self.config.axes, self.frame
        values = ["structure", "intensity"]
        if c.motility:
            speeds = tracking.motility(voxels, fw, bw, axes, c.spacing, c.dt, f)
            values = [x for x in speeds.columns if x not in (*f, "id")] + values
            voxels = voxels.join(speeds, [*f, "id"])
        voxels = checkpointed(voxels.withColumnRenamed("label", "organelle"))
        raw = lambda df, names: df.select(*f, "label", *[F.col(n).alias(f"{n}_raw") for n in names], *[x for x in df.columns if x not in (*f, "label", *names)])
        out = {"voxels": raw(voxels.select(*f, F.col("id").alias("label"), *values, *axes), [*values, *axes])}

        owner = voxels.select(*f, *axes, "organelle", F.col("branch").alias("own_branch"))
        radius = skeleton.drop("label").join(distances, [*f, *axes]).join(owner, [*f, *axes])
        nodes, node_values, in_node = None, [], None
        if c.nodes:
            nodes, node_values, in_node = self._nodes(voxels, radius, values, fw, bw)
            nodes = checkpointed(nodes)
            centre = self.physical(nodes.select(*f, "label", *axes))
            out["nodes"] = raw(nodes.drop("branch", "organelle", *axes), node_values).join(centre.toDF(*f, "label", *[f"{a}_raw" for a in axes]), [*f, "label"])

        def rollup(by: str | None, *below: tuple[DataFrame, list[str]]) -> DataFrame:
            """The five statistics of the tables below, each grouped by its column `by` (all of a frame without one)."""
            keys = [*f, by] if by else f
            made = [stats.five_stats(df.where(F.col(by) > 0) if by else df, keys, names) for df, names in below]
            rolled = made[0]
            for m in made[1:]:
                rolled = rolled.join(m, keys, "full")
            return rolled.withColumnRenamed(by, "label") if by else rolled.withColumn("label", F.lit(0).cast("long"))

        above = [(nodes, node_values)] if c.nodes else []
        branch_nodes = radius.where("branch is not null").withColumn("radius", F.col("distance") * F.lit(float(c.spacing_x))).select(*f, "branch", *axes, "radius")
        geometry = network.branch_geometry(branch_nodes, f, "branch", axes, c.spacing, "radius").withColumnsRenamed({k: f"branch_{k}" for k in ("length", "thickness", "aspect_ratio", "tortuosity")}).withColumnRenamed("branch", "label")
        regions_of = lambda level: self._regions(voxels, level)
        own = regions_of("branch").join(geometry, [*f, "label"], "left")
        own_values = [x for x in own.columns if x.startswith("branch_")]
        branches = checkpointed(own.join(features.branch_to_organelle(voxels, f).withColumnRenamed("branch", "label"), [*f, "label"], "left"))
        branch_table = raw(own, [*own_values, *axes]).join(rollup("branch", *above, (voxels, values)), [*f, "label"], "left")
        organelles = checkpointed(regions_of("organelle"))
        organelle_values = [x for x in organelles.columns if x.startswith("organelle_")]
        organelle_table = raw(organelles, [*organelle_values, *axes]).join(rollup("organelle", *above, (voxels, values), (branches, own_values)), [*f, "label"], "left")
        for level, table in (("branch", branch_table), ("organelle", organelle_table)):
            if f"new_{level}" in voxels.columns:
                new = features.reassigned_label(voxels, level, f"new_{level}", f).withColumnRenamed("reassigned_label", "reassigned_label_raw")
                table = table.join(new, [*f, "label"], "left")
            out["branches" if level == "branch" else "organelles"] = table
        out["image"] = rollup(None, *above, (voxels, values), (branches, own_values), (organelles, organelle_values))
        if c.adjacency:
            edges = features.containment_edges(voxels, f)
            if c.nodes:
                between = [(in_node.select(*f, "id", "node"), "id", "node", "v_n"), (nodes, "label", "branch", "n_b"), (nodes, "label", "organelle", "n_o")]
                for df, src, dst, kind in between:
                    edges = edges.unionByName(df.where(F.col(dst).isNotNull()).select(*f, F.lit(kind).alias("kind"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")))
            out["edges"] = edges
        return out

    def _nodes(self, voxels: DataFrame, radius: DataFrame, values: list[str], fw: DataFrame, bw: DataFrame) -> tuple[DataFrame, list[str], DataFrame]:
        """Nodes (skeleton cells, by scan order) with the statistics of the voxels in their boxes, their own features, and who is in them."""
        c, axes, f = self.config, self.config.axes, self.frame
        nodes = radius.select(*f, self.ordinal().alias("node"), *axes, "distance", F.col("own_branch").alias("branch"), "organelle")
        low = [F.greatest(F.floor(F.col(a) - F.col("distance")), F.lit(0)).alias(f"low_{a}") for a in axes]
        high = [F.least(F.floor(F.col(a) + F.col("distance")) + 1, F.lit(n)).alias(f"high_{a}") for a, n in c.shape.items()]
        inside = checkpointed(spatial.box_join(voxels, nodes.select(*f, "node", *low, *high), f, axes, 8))
        table = stats.five_stats(inside, [*f, "node"], values)
        own = nodes.withColumn("node_thickness", 2 * F.col("distance") * F.lit(float(c.spacing_x)))
        names = ["node_thickness"]
        if c.motility:
            flows = voxels.select(*f, "id", *axes)
            for flow, k in ((fw, "d"), (bw, "b")):
                flows = flows.join(flow.select(*f, "id", *[F.col(f"d{a}").alias(f"{k}{a}") for a in axes]), [*f, "id"], "left")
            spread = tracking.node_dynamics(inside.select(*f, "node", "id"), flows, nodes.select(*f, F.col("node").alias("id"), *axes), axes, f)
            # towards the node counts as convergence
            spread = spread.select(*f, "node", "divergence", (-F.col("convergence")).alias("convergence"), (F.col("divergence") - F.col("convergence")).alias("vergere"))
            own = own.join(spread, [*f, "node"], "left")
            names += ["divergence", "convergence", "vergere"]
        return own.drop("distance").join(table, [*f, "node"], "left").withColumnRenamed("node", "label"), names, inside

    def _regions(self, voxels: DataFrame, level: str) -> DataFrame:
        """t, label, <level>_area, .._extent, .._axis_length_maj, .._axis_length_min, .._solidity, and the centroid by axis."""
        c, axes, f = self.config, self.config.axes, self.frame
        rows = voxels.where(F.col(level) > 0).select(*f, F.col(level).alias("label"), *axes)
        made = regions.geometry(rows, [*f, "label"], axes, c.spacing).join(kernels.solidity(rows, [*f, "label"], axes), [*f, "label"])
        names = {"area": "area", "extent": "extent", "axis_major": "axis_length_maj", "axis_minor": "axis_length_min", "solidity": "solidity"}
        return made.withColumnsRenamed({k: f"{level}_{v}" for k, v in names.items()} | {f"centroid_{a}": a for a in axes})

    def tracks(self, seeds: DataFrame, flow: DataFrame, labelled: DataFrame, steps: int, forward: bool = True) -> DataFrame:
        return tracking.label_hits(tracking.extend_tracks(seeds, flow, self.config.axes, self.config.match_gate, steps, forward, self.frame), labelled, self.config.axes, self.frame)

    def view(self, table: DataFrame, feature: str, form: str | None = None, t: int | None = None, log: bool = False, robust: bool = False) -> DataFrame:
        rows = table if t is None else table.where(F.col("t") == t)
        return stats.view(rows, features.column_for(table, feature, form), log, robust)

    def save(self, tables: dict[str, DataFrame], store: StageStore, intermediate: bool = True) -> dict[str, DataFrame]:
        """The tables of a run written as stage tables, partitioned by the frame's keys, and read back; without the intermediate ones only the features."""
        stages = {name: stage for name, stage in STAGE_OF.items() if name in tables and (intermediate or stage in FEATURES)}
        return {name: store.write(stage, tables[name], self.config.keys) for name, stage in stages.items()}

    def run(self, frames: DataFrame) -> dict[str, DataFrame]:
        """Every table of a run over raw frames (t, axes, v): filter, label, network, markers, track, reassign, hierarchy."""
        axes, c, f = self.config.axes, self.config, self.frame
        frames = checkpointed(frames.select(*f[:-1], F.col("t").cast("int").alias("t"), *axes, "v"))
        ves = checkpointed(self.vesselness(frames))
        labels = checkpointed(self.label(ves, frames))
        skeleton, near = (checkpointed(x) for x in self.network(labels, ves))
        distances = checkpointed(self.distances(labels, frames))
        markers = checkpointed(self.markers(labels, frames, ves))
        flow = checkpointed(self.track_markers(markers))
        voxels = labels.join(near, [*f, "label", *axes], "left").join(frames.withColumnRenamed("v", "intensity"), [*f, *axes]).join(ves.withColumnRenamed("v", "structure"), [*f, *axes])
        voxels = voxels.select(*f, self.ordinal().alias("id"), *axes, "label", F.coalesce("branch", F.lit(0)).alias("branch"), "intensity", "structure")
        voxels = checkpointed(voxels)
        at = self.physical(voxels.select(*f, "id", *axes))
        fw, bw = (checkpointed(self.interpolate_flow(at, flow, forward)) for forward in (True, False))
        out = {"vesselness": ves, "labels": labels, "skeleton": skeleton, "border": self.border(labels), "markers": markers, "flow": flow}
        if c.reassign:
            out["matches"] = matches = checkpointed(self.matches(at, fw, bw))
            for level, column in (("organelle", "label"), ("branch", "branch")):
                carried = self.reassign(matches, voxels.select(*f, "id", F.col(column).alias("label")))
                out[f"reassigned_{level}s"] = carried
                voxels = voxels.join(carried.withColumnRenamed("label", f"new_{level}"), [*f, "id"], "left")
            voxels = checkpointed(voxels)
        return out | self.hierarchy(voxels, skeleton, distances, fw, bw)
