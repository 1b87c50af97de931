"""cairn: Spark-native automated tabular regression.

Every step of the regression workflow (source scan, target selection and
repair, missing-value profiling, exact-count train/test split, imputation,
scaling, categorical encoding, model fit, scoring and metrics) is expressed
as DataFrame expressions, aggregations and Spark ML stages, so one code path
serves a four-row CSV and a partitioned table of many terabytes.
"""

from cairn.config import (
    ArtifactSpec,
    CategoryPolicy,
    EvalPolicy,
    FileSpec,
    MissingPolicy,
    ModelPolicy,
    PipelineConfig,
    ScalingPolicy,
    SplitPolicy,
    TargetSpec,
)

__all__ = [
    "ArtifactSpec",
    "CategoryPolicy",
    "EvalPolicy",
    "FileSpec",
    "MissingPolicy",
    "ModelPolicy",
    "PipelineConfig",
    "ScalingPolicy",
    "SplitPolicy",
    "TargetSpec",
]
