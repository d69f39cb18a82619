"""What a check raises, and warns."""

from __future__ import annotations


class Refused(ValueError):
    """A statement that is refused: what, why, how to fix it, and how to opt out if one can."""

    def __init__(self, what: str, why: str = "", fix: str = "", opt_out: str = ""):
        self.what, self.why, self.fix, self.opt_out = what, why, fix, opt_out
        super().__init__(" ".join(x for x in (what, why, fix and f"Fix: {fix}", opt_out and f"Opt out: {opt_out}") if x))


class GuardRefused(Refused):
    """The result would probably be wrong."""


class LoadRefused(Refused):
    """The read or the result would be too large."""


class RepeatedRowsWarning(UserWarning):
    """A join may repeat rows."""
