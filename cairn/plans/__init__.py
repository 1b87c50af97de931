"""Composition of the operators into the fixed-order regression run."""

from cairn.plans.regression import RunResult, StepRegistry, run_regression, run_report, run_with_payload

__all__ = ["RunResult", "StepRegistry", "run_regression", "run_report", "run_with_payload"]
