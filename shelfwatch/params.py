"""Analysis parameters. One frozen object is passed through every operator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Params:
    # The published defaults of the analysis.
    slice_start: date = date(2016, 6, 21)      # analysis window minus a 56-day burn-in
    window_start: date = date(2016, 8, 16)     # first day a result may start on
    window_end: date = date(2017, 8, 15)       # last day, inclusive
    lookback_days: int = 28                    # length of every trailing window
    min_expected_units: float = 3.0            # rate threshold of the single-day rule
    min_receipts_share: float = 0.5            # a full day has at least this share of usual receipts
    post_promo_days: int = 7                   # days watched after a promotion
    max_run_days: int = 28                     # longer silences look like a delisting
    fdr_q: float = 0.05                        # false-discovery level
    bootstrap_resamples: int = 1000
    min_family_events: int = 30                # smaller families get no interval
    seed: int = 42

    def sql_args(self) -> dict[str, date | int | float]:
        """Named parameters for ``spark.sql(text, args=...)``; ``:stockout_from`` is the window's first day."""
        return {
            "slice_start": self.slice_start,
            "stockout_from": self.window_start,
            "lookback_days": self.lookback_days,
            "min_expected_units": self.min_expected_units,
            "min_receipts_share": self.min_receipts_share,
            "post_promo_days": self.post_promo_days,
        }
