"""Values that results depend on."""

from __future__ import annotations

# Evidence kinds, and each section's kinds in order of preference.
KINDS = ["motivation", "method", "algorithm", "equation", "result", "limitation", "comparison", "deployment", "definition"]
KIND_PRIORITY = {
    "summary": ["motivation", "method", "result", "limitation", "comparison"],
    "logic": ["definition", "equation", "algorithm", "method", "limitation"],
    "cpp": ["algorithm", "method", "definition", "equation", "deployment"],
    "diagrams": ["method", "algorithm", "definition", "comparison", "result"],
    "extras": ["limitation", "result", "comparison", "deployment", "motivation"],
}
# Sections in order, their labels, content columns and context caps.
SECTIONS = ["summary", "logic", "cpp", "diagrams", "extras"]
SECTION_LABELS = {"summary": "Summary", "logic": "Symbolic logic", "cpp": "C++ examples", "diagrams": "Graphviz diagrams", "extras": "Critical analysis"}
SECTION_COLUMNS = {"summary": "summary_md", "logic": "symbolic_logic_md", "cpp": "cpp_examples_md", "extras": "extras_md"}
CONTEXT_CAPS = {"summary": 45_000, "logic": 45_000, "cpp": 45_000, "diagrams": 30_000, "extras": 45_000}
# Model tiers by page count; beyond the last bound the default tier holds.
MODEL_TIERS = {"default": "gemma4:26b-a4b-it-q4_K_M", "reasoning": "qwen3.6:35b"}
TIER_BOUNDS = [(35, "default"), (200, "reasoning"), (999, "default")]
# Windows over pages.
WINDOW, OVERLAP, CHAR_CAP = 12, 2, 48_000
FRAGMENT_SLACK, FRAGMENT_CHARS_EXTRA, MIN_CHAR_CAP = 64, 32, 1_000
# Evidence synthesis.
GROUP, MAX_SELECTED, REPRESENTATIVES = 4, 16, 2
STATEMENT_CHARS, SUPPORT_CHARS, SUMMARY_CHARS, RELATION_CHARS = 1_000, 600, 3_000, 1_500
CHUNK_SUMMARY_CHARS, RETRIES = 4_000, 1
BUNDLE_VERSION = 1
# Page routing, leases, graph.
OCR_MIN_CHARS, OCR_BUDGET = 100, 40
LEASE_STALE_S, HEARTBEAT_S = 4 * 3600, 60
GRAPH_CHARS = 500
IDENTITY_PATTERN = r"\A[0-9a-f]{64}\z"
IDENTITY_SCHEME = "sha256-full-v1"
SCHEMA_VERSION = 4
PAPER_STATUSES = ["COMPLETE", "PARTIAL", "ALREADY_COMPLETE", "CLAIMED_ELSEWHERE", "INTERRUPTED", "FAILED"]
