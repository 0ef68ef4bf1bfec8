"""Job parameters (O-X24 config defaults).

The reference reads a 22-key configuration and falls back with PHP ``?:`` —
0, '' and NULL all count as unset. Here every job takes one frozen dataclass.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# Fixed values that must equal the reference's defaults.
DEFAULT_MAX_TRENDS = 5
DEFAULT_PROVIDER = "openai"
DEFAULT_OPENAI_MODEL = "gpt-4o-mini"
DEFAULT_CLAUDE_MODEL = "claude-3-5-sonnet-20241022"
DEFAULT_CONTENT_TYPE = "article"
DEFAULT_IMAGE_FIELD = "field_image"
TITLE_SEPARATOR = "---TITLE_SEPARATOR---"
TAGS_SEPARATOR = "---TAGS_SEPARATOR---"
TEXT_PIECE_SEPARATOR = "\n\n---\n\n"
NO_TAGS_TEXT = "No tags available"
UNTITLED_ARTICLE = "Untitled Article"
MAX_IMAGES = 10
LISTING_PAGE_SIZE = 25
DASHBOARD_TOP_N = 5


def _unset(v) -> bool:
    return v is None or v == 0 or v == "" or v == "0"


@dataclass(frozen=True)
class Params:
    import_enabled: bool = True
    cron_enabled: bool = True
    min_traffic: int | None = None
    max_trends: int | None = DEFAULT_MAX_TRENDS
    filtered_tlds: str | None = ""
    ai_provider: str | None = DEFAULT_PROVIDER
    openai_model: str | None = DEFAULT_OPENAI_MODEL
    claude_model: str | None = DEFAULT_CLAUDE_MODEL
    content_type: str | None = DEFAULT_CONTENT_TYPE
    image_field: str | None = DEFAULT_IMAGE_FIELD
    tag_field: str | None = ""
    tag_vocabulary: str | None = ""
    assign_random_author: bool = False
    author_seed: int = 0
    domain_id: str | None = ""
    skip_domain_source: bool = False
    translation_enabled: bool = False
    translation_languages: tuple[str, ...] = field(default_factory=tuple)
    prompt_template: str | None = None
    as_of: dt.datetime = dt.datetime(2001, 7, 15, 12, 0, 0)
    literal_quirks: bool = False

    # ---- effective values, with the reference's fallbacks ----
    @property
    def cap(self) -> int:
        return DEFAULT_MAX_TRENDS if _unset(self.max_trends) else int(self.max_trends)

    @property
    def min_traffic_effective(self) -> int | None:
        return None if _unset(self.min_traffic) else int(self.min_traffic)

    @property
    def provider(self) -> str:
        return DEFAULT_PROVIDER if _unset(self.ai_provider) else str(self.ai_provider)

    @property
    def model(self) -> str:
        if self.provider == "claude":
            return DEFAULT_CLAUDE_MODEL if _unset(self.claude_model) else str(self.claude_model)
        return DEFAULT_OPENAI_MODEL if _unset(self.openai_model) else str(self.openai_model)

    @property
    def content_type_effective(self) -> str:
        return DEFAULT_CONTENT_TYPE if _unset(self.content_type) else str(self.content_type)

    @property
    def image_field_effective(self) -> str:
        return DEFAULT_IMAGE_FIELD if _unset(self.image_field) else str(self.image_field)

    @property
    def languages(self) -> tuple[str, ...]:
        """Selected translation languages, blanks dropped (O-F8)."""
        return tuple(l for l in self.translation_languages if not _unset(l))

    @property
    def as_of_epoch(self) -> int:
        return int(self.as_of.replace(tzinfo=dt.timezone.utc).timestamp())
