"""All stages over the tables of a survey, resumable by stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import runs
from plumbline.params import Acceptance, CloudCleaning, FrameGate
from plumbline.plans import cloud_cleaning, frame_selection, georeference, masking, pose_qa, selection, training_set


@dataclass
class SurveyInputs:
    """Input tables; a stage without its inputs is skipped."""

    frames: DataFrame | None = None
    detections: DataFrame | None = None
    attempts: DataFrame | None = None
    poses: DataFrame | None = None
    fixes: DataFrame | None = None
    points: DataFrame | None = None
    training_images: DataFrame | None = None
    training_poses: DataFrame | None = None
    #: cameras, images, observations and points of sparse models
    model: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None


@dataclass
class SurveyPlan:
    gate: FrameGate = field(default_factory=FrameGate)
    cleaning: CloudCleaning = field(default_factory=CloudCleaning)
    policy: Acceptance = field(default_factory=Acceptance)
    sync_tolerance: float = 1.0


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


class Survey:
    """Writes every stage table below ``root`` and reads it back, so that later stages start from finished tables.

    A stage that raises is logged as FAILED and ends neither the run nor stages that do not need it. On resume a stage
    is kept unless one that it is built from was built again.
    """

    def __init__(self, spark: SparkSession, root: str, resume: bool = True):
        self.spark, self.root, self.resume = spark, root, resume
        self.log: list[tuple[int, str, str, str]] = []
        self.rebuilt: set[str] = set()

    def stage(
        self, name: str, build: Callable[[], dict[str, DataFrame]], tables: tuple[str, ...], after: Sequence[str] = ()
    ) -> dict[str, DataFrame] | None:
        """The stage's tables, or None if it failed; ``after`` names the stages that it is built from."""
        paths = {t: f"{self.root}/{name}/{t}" for t in tables}
        current = self.resume and not self.rebuilt.intersection(after)
        if current and all(_exists(self.spark, p) for p in paths.values()):
            self.log.append((len(self.log), name, "SUCCESS", "kept from an earlier run"))
        else:
            self.rebuilt.add(name)
            try:
                built = build()
                for table, path in paths.items():
                    built[table].write.mode("overwrite").parquet(path)
            except Exception as error:  # whatever a stage raises is that stage's failure
                self.log.append((len(self.log), name, "FAILED", f"{type(error).__name__}: {error}"[:500]))
                return None
            self.log.append((len(self.log), name, "SUCCESS", "written"))
        return {t: self.spark.read.parquet(p) for t, p in paths.items()}

    def run(self, data: SurveyInputs, plan: SurveyPlan = SurveyPlan()) -> dict[str, dict[str, DataFrame]]:
        out: dict[str, dict[str, DataFrame]] = {}

        def keep(name: str, *args, **kwargs) -> None:
            if (tables := self.stage(name, *args, **kwargs)) is not None:
                out[name] = tables

        if data.frames is not None:
            keep("frames", lambda: frame_selection.select(data.frames, plan.gate), ("manifest", "summary"))
        if data.detections is not None and "frames" in out:
            kept = out["frames"]["manifest"].filter("accepted").select("video_id", "frame_id", "width", "height")
            keep("masks", lambda: masking.mask(kept, data.detections), ("runs", "coverage", "summary"), after=("frames",))
        if data.attempts is not None:
            keep("selection", lambda: selection.select(data.attempts, policy=plan.policy), ("attempts", "selected", "failed"))
        if data.model is not None:
            keep("pose_qa", lambda: {"models": pose_qa.validate_models(*data.model)}, ("models",))
        if data.poses is not None and data.fixes is not None:
            keep(
                "georeference", lambda: georeference.georeference(data.poses, data.fixes, plan.sync_tolerance),
                ("flights", "cameras", "trajectory", "features"))
        if data.points is not None:
            keep("cloud", lambda: cloud_cleaning.clean(data.points, plan.cleaning), ("points", "before", "after", "stages", "report"))
        if data.training_images is not None and data.training_poses is not None:
            keep(
                "training", lambda: training_set.prepare(data.training_images, data.training_poses),
                ("frames", "intrinsics", "normalization", "record", "scenes"))
        report = {"stages": lambda: self.stage_rows(out), "status": lambda: self.status(out), "inventory": self.inventory}
        keep("report", lambda: {name: make() for name, make in report.items()}, tuple(report), after=[n for _, n, _, _ in self.log])
        return out

    def stage_rows(self, out: dict[str, dict[str, DataFrame]]) -> DataFrame:
        """Counts by status of every finished stage as ``(run_id, stage, metric, value)``."""
        rows = self.spark.createDataFrame([], "run_id string, stage string, metric string, value bigint")
        for stage, table, column in (
            ("frames", "manifest", "quality_status"), ("selection", "selected", "status"), ("pose_qa", "models", "validation_status"),
            ("georeference", "flights", "status"), ("cloud", "report", "status"), ("training", "scenes", "status"),
        ):
            if stage in out:
                rows = rows.unionByName(out[stage][table].groupBy(F.col(column).alias("metric")).agg(F.count(F.lit(1)).alias("value")).select(
                    F.lit(self.root).alias("run_id"), F.lit(stage).alias("stage"), "metric", "value"))
        return rows

    def status(self, out: dict[str, dict[str, DataFrame]]) -> DataFrame:
        """FAILED when a stage failed or a row is in error; COMPLETE_WITH_WARNINGS when any flight, scene or cloud is not clean."""
        rows = self.stage_rows(out).filter("stage <> 'frames'")
        clean = F.col("metric").isin("PASS", "READY", "COMPLETE")
        judged = rows.select("run_id", F.when(clean, "SUCCESS").when(F.col("metric") == "ERROR", "FAILED").otherwise("WARNING").alias("status"))
        stages = self.spark.createDataFrame([(self.root, status) for _, _, status, _ in self.log], "run_id string, status string")
        return runs.report_status(judged.unionByName(stages))

    def inventory(self) -> DataFrame:
        """``(run_id, stage, status, note)`` of every stage that was tried, in order."""
        return self.spark.createDataFrame([(self.root, i, *rest) for i, *rest in self.log], "run_id string, pos int, stage string, status string, note string")
