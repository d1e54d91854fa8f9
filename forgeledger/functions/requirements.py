"""Column functions on requirement lines: ``name[extras]spec ; markers``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Starts of lines that are options or addresses, not requirements.
SKIPPED_STARTS = ["#", "-", "git+", "hg+", "svn+", "bzr+", "http://", "https://"]

# White space and line ends as text files define them (Unicode).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Word characters are Unicode; everything up to ';' is the version part. The tail swallows
# what the grammar leaves over, so one replacement yields all four parts.
_GRAMMAR = r"(?U)^([a-zA-Z0-9][\w\-.]*+)(?:\[([^\]]+)\])?([^;]+)?(?:\s*;\s*(.+))?(?s:.*)$"
_STARTS = r"^[a-zA-Z0-9]"
_MARK = "\x01\x02\x03"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_ENDS)


def is_requirement(line: Column) -> Column:
    """False for blank lines, comments, option flags and addresses."""
    keep = line != ""
    for start in SKIPPED_STARTS:
        keep = keep & ~F.startswith(line, F.lit(start))
    return keep


def parse_line(line: Column) -> Column:
    """Array of at most one struct(name, extras, version_spec, markers) for ``F.inline``.

    Empty where no name starts the line. The steps are nested array functions, so the
    grammar runs once per line however many of its parts are used.
    """
    text = stripped(F.element_at(F.split(line, " #"), 1))
    named = F.filter(F.array(text), lambda t: t.rlike(_STARTS))
    marked = F.transform(
        named, lambda t: F.split(F.regexp_replace(t, _GRAMMAR, _MARK.join(["$1", "$2", "$3", "$4"])), _MARK)
    )
    return F.transform(
        marked,
        lambda part: F.struct(
            part[0].alias("name"),
            F.when(part[1] == "", F.array().cast("array<string>"))
            .otherwise(F.transform(F.split(part[1], ","), stripped))
            .alias("extras"),
            stripped(part[2]).alias("version_spec"),
            stripped(part[3]).alias("markers"),
        ),
    )


# Names, versions and specifiers as the packaging standards define them. Wildcards and local
# labels go with equality only, "~=" needs two release numbers, and commas part specifiers.
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9_])?"
_EPOCH = r"v?(?:[0-9]+!)?"
_PRE = r"(?:[-_.]?(?:alpha|a|beta|b|preview|pre|c|rc)[-_.]?[0-9]*)?"
_POST = r"(?:-[0-9]+|[-_.]?(?:post|rev|r)[-_.]?[0-9]*)?"
_DEV = r"(?:[-_.]?dev[-_.]?[0-9]*)?"
_LOCAL = r"(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?"
_SUFFIX = _PRE + _POST + _DEV
_NUMBERS = r"[0-9]+(?:\.[0-9]+)*"
_SPECIFIER = (
    rf"(?i:===\s*[^\s;)]+|(?:==|!=)\s*{_EPOCH}{_NUMBERS}(?:\.\*|{_SUFFIX}{_LOCAL})"
    rf"|~=\s*{_EPOCH}[0-9]+(?:\.[0-9]+)+{_SUFFIX}|(?:<=|>=|<|>)\s*{_EPOCH}{_NUMBERS}{_SUFFIX})"
)
_SPECIFIERS = rf"(?:{_SPECIFIER}(?:\s*,\s*{_SPECIFIER})*\s*,?)?"
_EXTRAS = rf"(?:\[\s*(?:{_NAME}(?:\s*,\s*{_NAME})*)?\s*\])?"
_REGISTRY = rf"^({_NAME})\s*{_EXTRAS}\s*(?:@\s*\S+|\(\s*({_SPECIFIERS})\s*\)|({_SPECIFIERS}))\s*$"


def parse_registry_requirement(text: Column) -> Column:
    """struct(name, version_spec) with markers cut off, or null where the text does not parse."""
    body = stripped(F.element_at(F.split(text, ";"), 1))
    found = F.concat(F.regexp_extract(body, _REGISTRY, 2), F.regexp_extract(body, _REGISTRY, 3))
    spec = F.regexp_replace(found, r"\s+|,\s*$", "")
    return F.when(
        body.rlike(_REGISTRY),
        F.struct(
            F.regexp_extract(body, _REGISTRY, 1).alias("name"),
            F.array_join(F.array_sort(F.split(spec, ",")), ",").alias("version_spec"),
        ),
    )
