"""Row types and settings of timed-text data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Settings:
    """Query parameters; times in milliseconds (fixed values are the public defaults)."""

    confidence_high: float = 0.90
    confidence_medium: float = 0.70
    confidence_unknown: float = 0.50
    max_chars: int = 42
    max_lines: int = 2
    min_cue_ms: int = 500
    max_cue_ms: int = 7000
    pause_gap_ms: int = 600
    sentence_pause_ms: int = 450
    speaker_gap_ms: int = 800
    max_cps: float = 17.0
    max_wps: float = 4.0
    min_caption_gap_ms: int = 80
    safety_mode: str = "strict"
    unknown_profanity: str = "censor"
    correction_threshold: float = 0.65
    context_window: int = 5
    sound_event_threshold: float = 0.80


_SAFETY_ALIASES = {"safe": "strict", "literal": "review-only", "review": "review-only"}


def safety_mode(value: str | None) -> str:
    """Normalised safety mode; unknown ones are ``strict``."""
    name = (value or "").strip().lower().replace("_", "-")
    name = _SAFETY_ALIASES.get(name, name)
    return name if name in ("strict", "balanced", "review-only") else "strict"


def unknown_profanity(value: str | None) -> str:
    """Normalised handling of words without a good alternative; unknown values ``censor``."""
    name = (value or "").strip().lower()
    return name if name in ("censor", "flag", "keep") else "censor"


def truthy(value: str | None) -> bool:
    """Booleans of configuration texts."""
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


def _seconds(text: str) -> int:
    return round(float(text) * 1000)


#: names of configuration texts, the settings they give and how they are read
_NAMED = {
    "CONFIDENCE_HIGH": ("confidence_high", float), "CONFIDENCE_MEDIUM": ("confidence_medium", float), "CONFIDENCE_UNKNOWN": ("confidence_unknown", float),
    "MAX_CHARS_PER_LINE": ("max_chars", int), "MAX_CAPTION_LINES": ("max_lines", int), "MIN_CUE_DURATION": ("min_cue_ms", _seconds), "MAX_CUE_DURATION": ("max_cue_ms", _seconds),
    "PAUSE_GAP": ("pause_gap_ms", _seconds), "PUNCTUATION_PAUSE": ("sentence_pause_ms", _seconds), "SPEAKER_CHANGE_GAP": ("speaker_gap_ms", _seconds), "MAX_CPS": ("max_cps", float), "MAX_WPS": ("max_wps", float),
    "MIN_CAPTION_GAP": ("min_caption_gap_ms", _seconds), "SAFETY_MODE": ("safety_mode", safety_mode), "UNKNOWN_PROFANITY": ("unknown_profanity", unknown_profanity),
    "CORRECTION_THRESHOLD": ("correction_threshold", float), "CONTEXT_WINDOW": ("context_window", int), "SOUND_EVENT_THRESHOLD": ("sound_event_threshold", float),
}


def settings_from(texts: Mapping[str, str]) -> Settings:
    """Settings from configuration texts such as the environment; blank and missing ones keep the defaults."""
    given = {name: read(texts[key].strip()) for key, (name, read) in _NAMED.items() if (texts.get(key) or "").strip()}
    return Settings(**given)


def creator_settings(stored: Mapping[str, object] | None) -> dict[str, object]:
    """A creator's stored choices over the defaults, normalised."""
    own = dict(stored) if isinstance(stored, Mapping) else {}
    return own | {
        "safety_mode": safety_mode(str(own.get("safety_mode") or "strict")), "unknown_profanity": unknown_profanity(str(own.get("unknown_profanity") or "censor")),
        "enable_sound_events": bool(own.get("enable_sound_events")), "enable_speaker_labels": bool(own.get("enable_speaker_labels", True)),
    }


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_STR, _DBL, _INT, _LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
WORD = _s(("word", _STR), ("start", _DBL), ("end", _DBL), ("confidence", _DBL), ("speaker", _STR))
TRANSCRIPT = _s(("text", _STR), ("words", T.ArrayType(WORD)), ("language", _STR), ("model", _STR), ("device", _STR))
READING_SPEED = _s(("cps", _DBL), ("wps", _DBL), ("status", _STR))
CAPTION = _s(
    ("index", _INT),
    ("start", _DBL),
    ("end", _DBL),
    ("text", _STR),
    ("lines", T.ArrayType(_STR)),
    ("words", T.ArrayType(WORD)),
    ("speaker", _STR),
    ("reading_speed", READING_SPEED),
    ("cps", _DBL),
    ("wps", _DBL),
    ("reading_status", _STR),
    ("flags", T.ArrayType(_STR)),
    ("mean_confidence", _DBL),
    ("confidence_band", _STR),
)
CAPTIONS = _s(("captions", T.ArrayType(CAPTION)))
CLIP = _s(
    ("id", _STR),
    ("reference_text", _STR),
    ("words", T.ArrayType(WORD)),
    ("gold_profane", T.ArrayType(_STR)),
    ("gold_clean", T.ArrayType(_STR)),
    ("gold_corrections", T.ArrayType(_s(("from", _STR), ("to", _STR)))),
    ("reference", _s(("text", _STR), ("words", T.ArrayType(WORD)))),
    ("hypothesis", _s(("text", _STR), ("words", T.ArrayType(WORD)))),
    ("safety", _s(("profane", T.ArrayType(_STR)), ("clean", T.ArrayType(_STR)), ("corrections", T.ArrayType(_s(("from", _STR), ("to", _STR)))))),
)
JOB = _s(
    ("job_id", _STR),
    ("status", _STR),
    ("original_filename", _STR),
    ("original_path", _STR),
    ("duration", _DBL),
    ("width", _INT),
    ("height", _INT),
    ("frame_rate", _DBL),
    ("file_size", _LONG),
    ("audio", _s(("codec", _STR), ("sample_rate", _INT), ("channels", _INT))),
    ("error", _STR),
)
