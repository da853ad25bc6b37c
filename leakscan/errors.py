"""Errors raised by the audit."""


class InputError(ValueError):
    """The caller's tables, columns or tolerances cannot be audited."""


class LeakageFound(RuntimeError):
    """A strict audit found leakage. ``summary`` is the one-row summary as a ``Row``."""

    def __init__(self, summary):
        self.summary = summary
        super().__init__(
            f"leakage found: {summary['exact_duplicate_rows']} exact and "
            f"{summary['near_duplicate_rows']} near test rows, "
            f"{summary['n_overlapping_groups']} shared groups"
        )
