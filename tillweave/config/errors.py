"""Errors a user meets. Messages carry positions, counts and names of settings, never cell text."""


class EngineError(Exception):
    """Base of all of them; the command line ends with status 1 on any."""


class ProfileError(EngineError):
    """A profile is malformed."""


class RuleError(EngineError):
    """A rules file is malformed; rules are named by position."""


class InputError(EngineError):
    """An input file lacks columns or holds cells that can't be read."""


class ExtractionError(EngineError):
    """A source file has no table where its profile says so."""


class CoercionError(EngineError):
    """Cells of a source can't be turned into dates or amounts."""


class BalanceContinuityError(EngineError):
    """Printed balances don't follow from the amounts."""
