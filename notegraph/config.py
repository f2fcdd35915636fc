"""Settings.  Defaults are part of the semantics; pass an own instance to change one."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """How notes are found, parsed, dated and cut into chunks."""

    # Folders that are never entered, what counts as a note, names of sync conflicts.
    skip_dirs: tuple[str, ...] = (".obsidian", ".trash", ".smart-env", ".git", "node_modules", "__pycache__")
    skip_hidden: bool = True
    suffixes: tuple[str, ...] = (".md",)
    conflict_patterns: tuple[str, ...] = (r"(?i)\.sync-conflict-[0-9]", r"(?i)\(conflicted copy", r"(?iU)\(\w+'s conflicted copy", r"(?iU)-\w+-PC\.md$", r"^~\$")
    # Dates.
    year_pivot: int = 40
    date_from_filename: bool = True
    date_keys: tuple[str, ...] = ("date", "created")
    # Chunks, in characters.
    target_chars: int = 1200
    max_chars: int = 2000
    min_chars: int = 250
    overlap_paras: int = 1
    meta_in_embedding: bool = True
    folder_in_breadcrumb: bool = True
    # Fenced blocks that are queries, and attachments.
    drop_fence_langs: tuple[str, ...] = ("dataview", "dataviewjs", "query", "tasks", "kanban-plugin")
    attachment_suffixes: tuple[str, ...] = (
        ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".avif", ".pdf", ".mp3", ".wav",
        ".m4a", ".ogg", ".flac", ".mp4", ".mov", ".webm", ".mkv", ".canvas", ".excalidraw", ".base",
    )


@dataclass(frozen=True)
class SearchOptions:
    """How a set of questions is answered with chunks."""

    top_k: int = 8
    candidates: int = 50
    rrf_k: int = 60
    weights: dict[str, float] = field(default_factory=lambda: {"vector": 1.0, "bm25": 1.0})
    #: Weight of a term in the breadcrumb, the body and the metadata.
    column_weights: tuple[float, float, float] = (2.0, 1.0, 1.5)
    use_bm25: bool = True
    use_vector: bool = True
    since: str | None = None
    until: str | None = None
    link_boost: float = 0.0
    link_seeds: int = 5
    per_note: int = 3
    dedupe: float = 0.95
    neighbours: int = 0
    min_score: float = 0.0


@dataclass(frozen=True)
class AnswerOptions:
    """How a prompt is packed."""

    max_tokens: int = 800
    n_ctx: int = 8192
    reserve_tokens: int = 320
    excerpt_chars: int = 1200
    expand_transclusions: bool = True
