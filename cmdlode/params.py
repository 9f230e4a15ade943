"""Tunable limits and the fixed word lists shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
# Tools too trivial for a report.
NOISE_TOOLS = (
    "cd", "ls", "ll", "la", "dir",
    "clear", "cls", "exit", "pwd",
    "history", "whoami", "echo", "cat", "type",
)
# Leading words that wrap another command.
WRAPPERS = ("sudo", "doas", "time", "nohup")
# Tools whose last argument is the thing being looked up.
HELP_TOOLS = ("man", "tldr", "help")
# Later tokens that turn a command into a help lookup.
HELP_FLAGS = ("--help", "-?", "/?")
# Suffixes removed from a tool name, once each, in this order.
TOOL_SUFFIXES = (".exe", ".cmd", ".bat", ".ps1")
# Text that replaces a secret.
PLACEHOLDER = "«redacted»"
# A tool name that is safe to store a sheet under.
SAFE_TOOL = r"^[a-z0-9][a-z0-9._+-]*\z"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Limits of the mining operators. Texts and paths are taken whole unless a limit is set."""

    max_hard_won: int = 8
    max_hits: int = 8
    min_hits: int = 3
    chain_window: int = 3
    sim_low: float = 0.65
    sim_max_bytes: int | None = None
    token_sim: float = 0.5
    near_tokens: int = 3
    max_fight_gap_s: int = 15 * 60
    max_victories: int = 8
    cooldown_s: int = 3600
    max_cmd_bytes: int | None = None
    max_stdin_bytes: int | None = None
    top_fights: int = 3
    tail_rows: int = 10
    max_ancestors: int | None = None
    # A caller's word lists, and scrubbing rules of (Java pattern, replacement) after the fixed ones.
    noise_tools: tuple[str, ...] = NOISE_TOOLS
    wrappers: tuple[str, ...] = WRAPPERS
    extra_rules: tuple[tuple[str, str], ...] = ()
    # Scale knobs. They split long sequences over tasks and never change results.
    bucket_rows: int = 1 << 20
    hot_key_rows: int = 1 << 22
    slice_s: int = 60
    max_scope_roots: int = 1000


DEFAULTS = Params()
# As above, with the limits of text and depth that a single-user tool sets.
LIMITED = Params(sim_max_bytes=300, max_cmd_bytes=8192, max_stdin_bytes=64 * 1024, max_ancestors=64)
