"""Text that leaves a page: neutralised, capped, tokenised, and URLs cut to what may be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsift.functions import pii
from loomsift.functions.cells import PLACEHOLDER, SPACE, trimmed

#: Marks that would end a prompt's data section; a dot goes between their characters.
FENCES = ("<<<PAGE_DATA", "PAGE_DATA>>>", "```", "<instructions>", "</instructions>", "<|im_start|>", "<|im_end|>", "<|system|>", "[INST]", "[/INST]")
ATOM_CHARS = 512
#: Words too common to choose an element by, and to tell candidates apart by.
GOAL_STOPWORDS = ("for", "the", "and", "with", "your", "you", "into", "this", "that", "from", "all", "any", "get", "set", "new")
AMBIGUITY_STOPWORDS = ("the", "a", "an", "to", "in", "on", "at", "for", "of", "and", "or", "my", "me", "i", "it", "this", "that", "with", "from", "into", "please", "go", "add", "open", "click", "find", "get", "set", "make", "do", "want", "need", "buy", "book", "search", "select", "choose", "show")
#: Phrases that ask for text to be entered; the first that begins the goal counts.
ENTRY_VERBS = ("search for", "search", "look up", "look for", "find", "type", "enter", "query", "fill in", "fill")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def neutralize(text: Column | str) -> Column:
    """Control characters to spaces, invisible ones out, fence marks broken, white space collapsed."""
    t = F.regexp_replace(_col(text), r"[\x{00}-\x{1F}\x{7F}-\x{9F}]", " ")
    t = F.regexp_replace(t, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]", "")
    for mark in FENCES:
        t = F.replace(t, F.lit(mark), F.lit("·".join(mark)))
    return trimmed(F.regexp_replace(t, f"{SPACE}+", " "))


def data_atom(text: Column | str, kind: str = "page-data") -> Column:
    """struct(kind, text, redacted, truncated): neutralised and capped."""
    t = neutralize(text)
    cut = F.length(t) > ATOM_CHARS
    return F.struct(F.lit(kind).alias("kind"), F.when(cut, F.concat(F.substring(t, 1, ATOM_CHARS), F.lit("..."))).otherwise(t).alias("text"), t.rlike(PLACEHOLDER).alias("redacted"), cut.alias("truncated"))


def clip_name(text: Column | str, most: int = 120, head: int = 72, tail: int = 44) -> Column:
    """A long name's head and tail, cut between words."""
    t = _col(text)
    first = F.regexp_replace(F.substring(t, 1, head), r"\s+\S*$", "")
    last = F.regexp_replace(F.right(t, F.lit(tail)), r"^\S*\s+", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(first, F.lit(" … "), last))


def words(text: Column | str, stopwords: tuple[str, ...], least: int = 3) -> Column:
    """ASCII words of at least `least` letters and digits that are no stopwords, in order."""
    return F.filter(F.split(F.lower(_col(text)), "[^a-z0-9]+"), lambda w: (F.length(w) >= least) & ~w.isin(*stopwords))


def goal_terms(goal: Column | str) -> Column:
    return F.array_distinct(words(goal, GOAL_STOPWORDS))


def text_intent(goal: Column | str) -> Column:
    """The text that a goal asks to enter, or null."""
    t = F.trim(_col(goal))
    verb = F.coalesce(*[F.when(F.startswith(F.lower(t), F.lit(v)), F.lit(v)) for v in ENTRY_VERBS])
    rest = F.trim(F.substring(t, F.length(verb) + 1, F.length(t)))
    bare = F.trim(F.regexp_replace(F.regexp_replace(rest, r"^(?i:for|me|a|an|the|:)\s+", ""), "^[\"']|[\"']$", ""))
    return F.when(verb.isNotNull() & (bare != ""), bare)


def sanitize_url(url: Column | str) -> Column:
    """Origin and path of an absolute URL; of any other text what stands before ? or #."""
    u = _col(url)
    origin = F.lower(F.regexp_extract(u, r"^(?i)([a-z][a-z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]+)", 1))
    host = F.lower(F.regexp_extract(u, r"^(?i)([a-z][a-z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]+)", 2))
    path = F.regexp_extract(u, r"^(?i)[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(origin != "", F.concat(origin, host, F.when(path == "", "/").otherwise(path))).otherwise(F.regexp_extract(u, "^([^?#]*)", 1))


#: Names of settings whose values are credentials.
CREDENTIAL_NAMES = "password|passwd|secret|token|api_?key"


def mask_credentials(text: Column | str) -> Column:
    """For logs: keys of the forms that the personal data rules know become ***, as do values of credentials' settings and authorisation headers.

    A setting's value is what its quotes hold, or goes to the next space, comma, semicolon or ampersand; a header's goes to
    the end of its line or quotes. How long they are doesn't count.
    """
    key = next(r for r in pii.RULES if r.kind == "api-key")
    out = F.regexp_replace(_col(text), pii.java_pattern(key), "***")
    out = F.regexp_replace(out, r"""(?i)(authorization["']?\s*[:=]\s*["']?)[^"'\r\n]+""", "$1***")
    return F.regexp_replace(out, rf"""(?i)((?:{CREDENTIAL_NAMES})["']?\s*[:=]\s*)("[^"]*"|'[^']*'|[^\s"',;&]+)""", "$1***")


def normal_target(text: Column | str) -> Column:
    """A target's text for comparison: entities decoded, placeholders by kind only, no ellipsis at the end, one case."""
    t = _col(text)
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"(?i)\[\[PII:([A-Z_]+)(?::\d+:[0-9a-f]*)?\]\]", "[[pii:$1]]")
    t = F.regexp_replace(t, r"(?:…|\.\.\.)\s*$", "")
    return F.lower(trimmed(F.regexp_replace(t, f"{SPACE}+", " ")))


def fill_outcome(before: Column, expected: Column, actual: Column, input_type: Column) -> Column:
    """What a field did with the text: exact, equivalent, appended, unchanged or transformed."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\x{200B}-\x{200D}\x{FEFF}]", "")
    b, e, a = clean(before), clean(expected), clean(actual)
    number = (input_type == "number") & (a.try_cast("double") == e.try_cast("double"))
    digits = (e != "") & e.rlike(r"^[0-9]+$") & (F.regexp_replace(a, r"\D", "") == e)
    return F.when(a == e, "exact").when(F.coalesce(number, F.lit(False)) | digits, "equivalent").when((b != "") & (a == F.concat(b, e)), "appended").when(a == b, "unchanged").otherwise("transformed")


def downscale(width: Column, height: Column, longest: float) -> Column:
    """Size of a picture shrunk to its longest edge; never grown."""
    s = F.least(F.lit(1.0), longest / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.round(width * s)).cast("int").alias("width"), F.greatest(F.lit(1), F.round(height * s)).cast("int").alias("height"))


def data_url_bytes(url: Column | str) -> Column:
    """Bytes that a base64 data URL holds."""
    body = F.regexp_extract(_col(url), r"^[^,]*,(.*)$", 1)
    pad = F.length(F.regexp_extract(body, "(=*)$", 1))
    return F.greatest(F.lit(0), F.floor(F.length(body) * 3 / 4) - pad).cast("long")
