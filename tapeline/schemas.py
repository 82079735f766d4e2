"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from dataclasses import dataclass

SEGMENT = "struct<start:double,end:double,text:string>"
RESULT = f"struct<text:string,segments:array<{SEGMENT}>>"
MEDIA_FILE = "file_index long, path string, name string, folder string"

#: Languages that a run may name, with their titles.
LANGUAGES = {"de": "German", "en": "English"}


@dataclass(frozen=True)
class Settings:
    """Settings of one run; checked when made. The pause between files is kept as a setting, but no job waits."""

    language: str = "de"
    model_name: str = "large"
    include_timecodes: bool = True
    buffer_seconds: int = 2
    output_folder: str | None = None
    device: str = "cpu"
    heading: str = "Transkript"
    timecodes_key: bool = True

    def __post_init__(self) -> None:
        if self.language not in LANGUAGES:
            raise ValueError(f"language must be one of {', '.join(LANGUAGES)}")
        object.__setattr__(self, "model_name", (self.model_name or "").strip() or "large")
        object.__setattr__(self, "buffer_seconds", min(60, max(0, self.buffer_seconds)))

    def check(self, files: int, folder_needed: bool = False, running: bool = False) -> None:
        """What must hold before a run starts."""
        if running:
            raise ValueError("a run is going on")
        if files < 1:
            raise ValueError("no file is selected")
        if folder_needed and not self.output_folder:
            raise ValueError("an output folder is needed")


def first_set(*options: str | None) -> str | None:
    """The first option that is neither missing nor empty."""
    return next((x for x in options if x), None)
