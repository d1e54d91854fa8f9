"""Version checks. The ordering rules of package versions have no built-in Spark equivalent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from packaging.specifiers import SpecifierSet
    from packaging.version import Version
except ImportError:  # pragma: no cover - depends on the cluster image
    SpecifierSet = Version = None

# Parsed versions, specifiers and verdicts a task remembers at most.
_REMEMBERED = 100_000


def _parsed(kind: type, text: str) -> object | None:
    try:
        return kind(text)
    except ValueError:
        return None


@F.pandas_udf(T.BooleanType())
def satisfies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether a version meets a specifier set.

    A specifier that cannot be read constrains nothing; a version that cannot be read meets
    nothing. Every text is parsed, and every pair compared, once per task.
    """
    if Version is None:
        raise ImportError("version checks need the packaging library on every executor")
    versions, specs, verdicts = {}, {}, {}
    for version, spec in batches:
        if len(verdicts) > _REMEMBERED:
            versions, specs, verdicts = {}, {}, {}
        found = []
        for pair in zip(version, spec):
            if pair not in verdicts:
                have, want = pair
                if have not in versions:
                    versions[have] = _parsed(Version, have) if isinstance(have, str) else None
                if want not in specs:
                    specs[want] = _parsed(SpecifierSet, want) if isinstance(want, str) else None
                candidate, wanted = versions[have], specs[want]
                verdicts[pair] = candidate is not None and (wanted is None or wanted.contains(candidate))
            found.append(verdicts[pair])
        yield pd.Series(found, dtype=bool)
