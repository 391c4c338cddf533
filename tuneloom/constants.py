"""Prompt formats, task specifications, model table, thresholds.

They are part of the data contract (a model trained on one prompt format is
scored on the same one), so they are stated here as plain text.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: training prompt format and context join -------------------
INSTRUCTION_HEAD = "### Instruction:\n"
RESPONSE_HEAD = "\n\n### Response:\n"
CONTEXT_HEAD = "\n\nContext:\n"
IGNORE_LABEL = -100

# --- fixed values: field priorities of the loose input shapes ----------------
PROMPT_KEYS = ("prompt", "instruction", "question", "input")
COMPLETION_KEYS = ("completion", "response", "output", "answer")
CONTEXT_KEYS = ("context", "input")
TEXT_KEYS = ("text", "content")

# --- fixed values: request defaults and routes -------------------------------
CHAT_ROUTE = "/v1/chat/completions"
COMPLETION_ROUTE = "/v1/completions"
DEFAULT_MAX_TOKENS = 128
DEFAULT_TEMPERATURE = 0.7

# --- fixed values: batching choice and overfit thresholds --------------------
PACK_MIN_GAIN = 1.15
PACK_MAX_P90_SHARE = 0.5
HEALTHY_GAP = 0.5
WATCH_GAP = 1.0

# --- fixed values: known model aliases and size hints in model names ---------
MODEL_PRESETS = [
    ("phi-3", "microsoft/Phi-3-mini-4k-instruct", 3.8),
    ("llama-3-1b", "meta-llama/Llama-3.2-1B", 1.2),
    ("llama-3-3b", "meta-llama/Llama-3.2-3B", 3.2),
    ("qwen-1.5b", "Qwen/Qwen2.5-1.5B", 1.5),
    ("gpt2", "gpt2", 0.124),
]
SIZE_HINTS = [("70b", 70.0), ("13b", 13.0), ("8b", 8.0), ("7b", 7.0),
              ("3b", 3.2), ("1b", 1.2), ("0.5b", 0.5)]
DEFAULT_PARAMS_B = 1.5


@dataclass(frozen=True)
class Task:
    """A classification task: where its text and label live, and its prompt."""

    name: str
    source: str
    train_split: str
    test_split: str
    text_key: str
    template: str
    labels: tuple[str, ...] | None = None
    label_key: str = "label"
    label_text_key: str | None = None


# --- fixed values: classification tasks --------------------------------------
TASKS = {
    "banking77": Task(
        name="banking77", source="mteb/banking77",
        train_split="train", test_split="test",
        text_key="text", label_text_key="label_text",
        template=("Classify this banking customer message as one of the following intents:\n"
                  "{labels}\n\nMessage: {text}\n\n"
                  "Answer with one intent name exactly as written above.")),
    "emotion": Task(
        name="emotion", source="dair-ai/emotion",
        train_split="train", test_split="test",
        text_key="text",
        labels=("sadness", "joy", "love", "anger", "fear", "surprise"),
        template=("Classify the emotion expressed in this text as one of: {labels}.\n\n"
                  "Text: {text}\n\nAnswer with one word.")),
    "sst2": Task(
        name="sst2", source="stanfordnlp/sst2",
        # the labels of its test split are hidden
        train_split="train", test_split="validation",
        text_key="sentence", labels=("negative", "positive"),
        template=("Classify the sentiment of this movie review as positive or negative.\n\n"
                  "Review: {text}\n\nAnswer with one word.")),
}

# Fixed value: the pattern that cuts texts into pieces before a byte-pair vocabulary merges them.
PIECE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                 r"|\s+(?!\S)|\s+")
