"""Client registry: User-Agent prefixes of known coding clients.

# --- fixed values: (client id, display name, category, provider, prefixes), match order
"""

from __future__ import annotations

CLIENTS: list[tuple[str, str, str, str, tuple[str, ...]]] = [
    ("claude_code", "Claude Code", "cli", "anthropic", ("claude-code/",)),
    ("copilot_cli", "GitHub Copilot CLI", "cli", "multi", ("copilot/",)),
    ("aider", "Aider", "cli", "multi", ("aider/",)),
    ("codex_cli", "OpenAI Codex CLI", "cli", "openai", ("codex/", "openai-codex/")),
    ("opencode", "OpenCode", "cli", "multi", ("opencode/",)),
    ("gemini_cli", "Gemini CLI", "cli", "gemini", ("geminicli/", "gemini-cli/")),
    ("cursor", "Cursor", "ide", "multi", ("cursor/",)),
    ("copilot", "GitHub Copilot", "ide", "openai", ("github-copilot/", "copilot-")),
    ("continue", "Continue", "ide", "multi", ("continue/",)),
    ("cody", "Cody", "ide", "multi", ("cody/", "sourcegraph-")),
    ("cline", "Cline", "ide", "multi", ("cline/",)),
    ("roo_code", "Roo Code", "ide", "multi", ("roo-code/", "roo/")),
    ("aide", "Aide", "ide", "multi", ("aide/", "codestory/")),
    ("droid", "Droid", "cli", "multi", ("droid/", "factory/")),
    ("codebuddy", "CodeBuddy", "cli", "multi", ("codebuddy/",)),
    ("kilo_code", "Kilo Code", "ide", "multi", ("kilo-code/", "kilo/")),
    ("windsurf", "Windsurf", "ide", "multi", ("windsurf/", "codeium/")),
    ("amazon_q", "Amazon Q Developer", "ide", "multi", ("amazon-q/", "aws-toolkit/")),
    ("tabnine", "Tabnine", "ide", "multi", ("tabnine/",)),
    ("augment", "Augment Code", "ide", "multi", ("augment/",)),
    ("gemini_assist", "Gemini Code Assist", "ide", "gemini", ("gemini-code-assist/",)),
    ("antigravity", "Antigravity", "ide", "multi", ("antigravity/",)),
    ("kiro", "Kiro", "ide", "multi", ("kiro/",)),
    ("kiro_cli", "Kiro CLI", "cli", "multi", ("kiro-cli/",)),
    ("trae", "Trae", "ide", "multi", ("trae/",)),
    ("qoder", "Qoder", "ide", "multi", ("qoder/",)),
    ("warp", "Warp", "cli", "multi", ("warp/",)),
]
