"""Predicates over columns: which rows may pass, and labels derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make a text count as visible: anything but controls, formats, separators and non-spacing or enclosing marks.
VISIBLE = r"[^\p{Cc}\p{Cf}\p{Z}\p{Mn}\p{Me}]"
#: Control characters and noncharacters that plain text may not hold.
FORBIDDEN = r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x9F\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"


def has_visible_text(text: Column) -> Column:
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def plain_text_ok(text: Column) -> Column:
    return ~F.coalesce(text.rlike(FORBIDDEN), F.lit(False)) & has_visible_text(text)


def length_between(text: Column, low: int, high: int) -> Column:
    n = F.length(F.trim(text))
    return F.coalesce((n >= low) & (n <= high), F.lit(False))


def title_of(name: Column, default: str = "Untitled") -> Column:
    """Stem of a file name, else the whole name, else a default."""
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.coalesce(F.nullif(F.trim(stem), F.lit("")), F.nullif(F.trim(name), F.lit("")), F.lit(default))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def vector_ok(v: Column, dims: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dims) & finite & squared_norm(v).between(0.99, 1.01), F.lit(False))


def unit_norm_ok(v: Column, tolerance: float = 1e-4) -> Column:
    return F.coalesce(F.abs(F.sqrt(squared_norm(v)) - 1) <= tolerance, F.lit(False))


def loopback_url_ok(url: Column, highest_port: int = 65_535) -> Column:
    """http(s) on this machine only, with nothing but an empty path: no user, query or fragment. The reference takes any port of five digits."""
    port = F.regexp_extract(url, r":([0-9]{1,5})/?\z", 1)
    return F.coalesce(url.rlike(r"^(?i:https?)://(?i:localhost|127\.0\.0\.1|\[::1\])(?::[0-9]{1,5})?/?\z") & ((port == "") | (port.try_cast("int") <= highest_port)), F.lit(False))


def increasing(times: Column) -> Column:
    return F.when(F.size(times) < 2, True).otherwise(F.forall(F.sequence(F.lit(0), F.size(times) - 2), lambda i: F.get(times, i) < F.get(times, i + 1)))


def media_ref_ok(kind: Column, start: Column, end: Column, image_index: Column, source: Column, frame_times: Column) -> Column:
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    image = start.isNull() & end.isNull()
    timed = finite(start) & finite(end) & (start >= 0) & (start < end) & image_index.isNull()
    no_frames = frame_times.isNull() | (F.size(frame_times) == 0)
    frames = no_frames | (F.size(frame_times).between(1, 8) & F.forall(frame_times, lambda t: (t >= start) & (t <= end)) & increasing(frame_times))
    by_kind = F.when(kind == "image", image & no_frames).when(kind == "audio", timed & (source != "ocr") & no_frames).when(kind == "video", timed & frames)
    return F.coalesce(by_kind, F.lit(False))


def media_payload_ok(kind: Column, n_frames: Column, has_audio: Column, times: Column) -> Column:
    aligned = (F.size(times) == n_frames) & F.forall(times, lambda t: ~F.isnan(t) & (F.abs(t) < float("inf")) & (t >= 0)) & increasing(times)
    by_kind = F.when(kind == "image", (n_frames == 1) & ~has_audio).when(kind == "audio", (n_frames == 0) & has_audio).when(kind == "video", n_frames.between(1, 8) & aligned)
    return F.coalesce(by_kind, F.lit(False))


def source_label(title: Column, position: Column, page: Column) -> Column:
    return F.when(position.isNotNull(), F.concat_ws(" · ", title, position)).when(page.isNotNull(), F.concat(title, F.lit(" · page "), page.cast("string"))).otherwise(title)


def clock(seconds: Column) -> Column:
    """mm:ss or h:mm:ss, with .mmm where the fraction exceeds 1e-4."""
    ms = F.round(seconds * 1000).cast("long")
    whole, rest = F.floor(ms / 1000), ms % 1000
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    base = F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", two(m), two(s)))
    return F.when(rest > 0, F.concat(base, F.lit("."), F.lpad(rest.cast("string"), 3, "0"))).otherwise(base)


def position_label(kind: Column, start: Column, end: Column, image_index: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(clock(start), F.lit("–"), clock(end))).when(image_index.isNotNull(), F.concat(F.lit("frame "), (image_index + 1).cast("string"))).otherwise(kind)
