"""Numeric and label expressions for run / stage analytics (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def throughput(n: Column | str, seconds: Column | str) -> Column:
    """n / seconds as DOUBLE; 0.0 (not NULL) when seconds <= 0 or NULL."""
    n, seconds = _col(n), _col(seconds)
    return F.when(seconds > 0, F.try_divide(n.cast("double"), seconds)).otherwise(F.lit(0.0))


def ms_to_s(c: Column | str) -> Column:
    """Milliseconds -> seconds (DOUBLE)."""
    return _col(c).cast("double") / F.lit(1000.0)


def efficiency_pct(part: Column | str, whole: Column | str) -> Column:
    """part / whole * 100; NULL when whole is 0 or NULL."""
    return F.try_divide(_col(part).cast("double"), _col(whole)) * F.lit(100.0)


def total_cores(workers: Column | str = "num_workers", cores: Column | str = "cores_per_worker") -> Column:
    """workers x cores per worker."""
    return _col(workers) * _col(cores)


def config_label(workers: Column | str = "num_workers", cores: Column | str = "cores_per_worker") -> Column:
    """'{W}W-{C}C', e.g. '16W-4C'."""
    return F.concat(_col(workers).cast("string"), F.lit("W-"), _col(cores).cast("string"), F.lit("C"))


def axis_label(kind: str, workers: Column | str = "num_workers",
               cores: Column | str = "cores_per_worker",
               scale: Column | str = "dataset_scale") -> Column:
    """Chart tick label.

    ``kind="scale"``: total cores, newline, '(scale=<scale>)';
    ``kind="workers"``: '{W}W', newline, '{C}C'.
    """
    if kind == "scale":
        return F.concat(total_cores(workers, cores).cast("string"), F.lit("\n(scale="),
                        _col(scale).cast("string"), F.lit(")"))
    if kind == "workers":
        return F.concat(_col(workers).cast("string"), F.lit("W\n"), _col(cores).cast("string"), F.lit("C"))
    raise ValueError(f"unknown label kind {kind!r}")
