"""Column functions on text: stripping, cleaning, tokenising, chunking, identifiers and formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of a watch link, and the length of a strict identifier.
LINK_SHORT = r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([^&\n?#]+)"
LINK_ANY = r"youtube\.com/watch\?.*v=([^&\n?#]+)"
LINK_STRICT = r"(?:youtube\.com/watch\?v=|youtu\.be/)([a-zA-Z0-9_-]{11})"
#: A line that holds a time stamp only; m: lines, d: only \n ends a line, U: Unicode classes.
STAMP_LINE = r"(?mdU)^\s*\d{1,2}:\d{2}(?::\d{2})?\s*[-–—]?\s*$"

Text = Column | str


def col(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Text) -> Column:
    """Without white space of any script at both ends; null stays null."""
    return F.regexp_replace(col(value), r"(?U)^\s+|\s+$", "")


def is_blank(value: Text) -> Column:
    """Null, empty or spaces only."""
    return F.trim(F.coalesce(col(value), F.lit(""))) == ""


def or_default(value: Text, default: str) -> Column:
    """The stripped text, or a default where it is null or blank."""
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(default))


def strip_stamps(value: Text) -> Column:
    """A pasted transcript without lines that are only time stamps and without blank lines; paragraphs stay apart."""
    bare = F.regexp_replace(col(value), STAMP_LINE, "")
    lines = F.filter(F.transform(F.split(bare, r"\R"), strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n\n")).otherwise(strip(bare))


def words(value: Text, least: int = 1) -> Column:
    """Runs of letters, digits and underscores in lower case, of at least ``least`` characters; repeats are kept."""
    found = F.regexp_extract_all(F.lower(col(value)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= least) if least > 1 else found


def chunks(value: Text, size: int = 800, overlap: int = 200) -> Column:
    """Windows of ``size`` characters that share ``overlap``, stripped, as structs (ordinal, chunk); blank ones are dropped.

    A text within the size is one chunk. Null gives null, an empty text one empty chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than the chunk")
    step = size - overlap
    behind = -(-overlap // step)  # blocks after its own that a window reaches into

    def windows(text: Column) -> Column:
        last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1)).cast("int") - 1
        # the text is read once into blocks of a step; a window is its block and the beginning of the next
        cut = lambda blocks: F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(F.array_join(F.slice(blocks, i + 1, behind + 1), ""), 1, size)))
        parts = _bound(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0)), cut)
        return F.when(last == 0, F.array(text)).otherwise(F.filter(parts, lambda c: c != ""))

    text = strip(value)
    return F.when(text.isNotNull(), F.transform(_bound(text, windows), lambda c, i: F.struct(i.alias("ordinal"), c.alias("chunk"))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def video_id(url: Text, strict: bool = False) -> Column:
    """The identifier in a watch link; null where there is none. strict: eleven characters, short forms only."""
    u = col(url)
    if strict:
        return F.nullif(F.regexp_extract(u, LINK_STRICT, 1), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(u, LINK_SHORT, 1), F.lit("")), F.nullif(F.regexp_extract(u, LINK_ANY, 1), F.lit("")))


def canonical_url(video: Text) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), col(video))


def record_id(video: Text, kind: str, ordinal: Text | None = None) -> Column:
    """Identifier of an index record: video, kind and, for repeated kinds, ordinal."""
    parts = [col(video), F.lit(kind)] + ([] if ordinal is None else [col(ordinal).cast("string")])
    return F.when(col(video).isNotNull(), F.concat_ws(":", *parts))


def brief_header(title: Text, channel: Text, date: Text) -> Column:
    """The four header lines of a brief, and the blank line after them."""
    # fixed values: the labels and defaults
    who = or_default(channel, "Unknown channel")
    lines = [F.concat(F.lit("SOURCE: "), or_default(title, "Untitled")), F.concat(F.lit("CHANNEL: "), who), F.concat(F.lit("DATE: "), or_default(date, "unknown")), F.concat(F.lit("CREATOR: "), who)]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def context_block(layer: Text, video: Text, ordinal: Text, text: Text) -> Column:
    """One passage as it is shown to an answer provider."""
    chunk = F.when(col(ordinal).isNotNull(), F.concat(F.lit(" chunk="), col(ordinal).cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), col(layer), F.lit("] video_id="), F.coalesce(col(video), F.lit("unknown_video")), chunk, F.lit("\n"), F.coalesce(col(text), F.lit("")), F.lit("\n"))


def fill(template: str, **values: Text) -> Column:
    """A prompt: the template with its {names} replaced; null values become empty."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col(value).cast("string"), F.lit("")))
    return out


def stamp(value: Text) -> Column:
    """A timestamp as text that sorts like the time."""
    return F.date_format(col(value), "yyyy-MM-dd HH:mm:ss")


def token_estimate(value: Text) -> Column:
    """A quarter of the characters, rounded down; 0 for null and empty."""
    return F.coalesce(F.floor(F.length(col(value)) / F.lit(4)), F.lit(0)).cast("long")


def show_count(value: Text) -> Column:
    return F.concat(F.lit("~"), F.format_number(col(value), 0))


def fetch_error(message: Text) -> Column:
    """A fetch error in plain words; other messages as they are."""
    # fixed values: parts of messages and what they mean
    m = col(message)
    return (
        F.when(m.contains("No transcript"), F.lit("No transcript available for this video"))
        .when(m.contains("Video unavailable"), F.lit("Video is unavailable or private"))
        .otherwise(m)
    )


def tsv_field(value: Text) -> Column:
    """Fit for one field of a tab-separated line."""
    return F.regexp_replace(F.coalesce(col(value), F.lit("")), r"[\t\r\n]", " ")


def embed_input(value: Text) -> Column:
    """What an embedder reads of a text: words only, so punctuation and case do not matter."""
    return F.array_join(words(value), " ")
