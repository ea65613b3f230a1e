"""Job options. A run changes them on its own copy, the defaults stay as they are."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Default limits and weights of an audit.
MAX_PAGES = 50
MAX_DEPTH = 3
MAX_EXTERNAL_CHECKS = 100
PAGE_SIZE_THRESHOLD = 3_145_728
BASE_SCORE = 100
WEIGHT_CRITICAL = 8
WEIGHT_WARNING = 3
WEIGHT_INFO = 1
SUGGESTION_PAGES = 5
TITLE_MIN, TITLE_MAX = 30, 60
DESCRIPTION_MIN, DESCRIPTION_MAX = 70, 160
THIN_TEXT = 200
SHELL_TEXT = 120


@dataclass(frozen=True)
class Scoring:
    base: int = BASE_SCORE
    critical: int = WEIGHT_CRITICAL
    warning: int = WEIGHT_WARNING
    info: int = WEIGHT_INFO


@dataclass(frozen=True)
class AuditOptions:
    max_pages: int = MAX_PAGES
    max_depth: int = MAX_DEPTH
    same_host_only: bool = True
    respect_robots: bool = True
    user_agent: str = "crawlsight/0.1"
    check_external_links: bool = True
    max_external_checks: int = MAX_EXTERNAL_CHECKS
    page_size_threshold: int = PAGE_SIZE_THRESHOLD
    scoring: Scoring = field(default_factory=Scoring)
    save: bool = False
    compare: bool = False
    optimize: bool = False
    target_keywords: tuple[str, ...] = ()
    suggestion_pages: int = SUGGESTION_PAGES

    def overlay(self, **changes) -> AuditOptions:
        """A copy with every change that is not None applied."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    @property
    def persists(self) -> bool:
        return self.save or self.compare
