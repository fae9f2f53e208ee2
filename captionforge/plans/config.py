"""Settings of a run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..functions.lang import canonical
from ..functions.text_rules import Step, mid_process

#: What the models are asked to do: the fallback reads a picture, the classifier tells italic tokens.
PROMPTS = {
    "en": "Read the subtitle text in this image. Answer with the text only.",
    "ja": "この画像の字幕を読み取り、文字だけを答えてください。",
}

ITALICS = {
    "en": "The second image shows the same text upright. Answer with JSON: {\"classification\": [...]}, for each token \"I\" if it is italic in the first image, else \"R\".",
    "ja": "二枚目は同じ文字の正立体です。各語が一枚目で斜体なら\"I\"、そうでなければ\"R\"とし、JSON {\"classification\": [...]} で答えてください。",
}


@dataclass(frozen=True)
class PipelineConfig:
    """track: place among the bitmap tracks, -1 to choose by language. verify_threshold: least score at which the first
    recogniser is believed. italic_threshold: least angle of italics in degrees. output: folder of the SRT files.
    debug: write the pictures between the steps to debug_dir, a table by stage. A language that isn't known has the
    settings of English. text_steps, file_rules and fallback_rules take the place of the language's own, in their order."""

    language: str = "en"
    track: int = -1
    verify_threshold: float = 0.97
    italic_threshold: float = 3.0
    output: str | None = None
    debug: bool = False
    debug_dir: str | None = None
    text_steps: tuple[Step, ...] | None = None
    file_rules: tuple[Callable[[DataFrame], DataFrame], ...] | None = None
    fallback_rules: Mapping[str, Callable[..., Column]] | None = None

    def __post_init__(self):
        if self.debug and not self.debug_dir:
            raise ValueError("debug needs debug_dir")
        if not 0 <= self.verify_threshold <= 1:
            raise ValueError("verify_threshold must be between 0 and 1")
        if not 0 <= self.italic_threshold <= 45:
            raise ValueError("italic_threshold must be between 0 and 45")
        if self.track < -1:
            raise ValueError("track must be -1 or more")

    @property
    def code(self) -> str:
        return canonical(self.language)

    @property
    def prompt(self) -> str:
        return PROMPTS.get(self.code, PROMPTS["en"])

    @property
    def italics_prompt(self) -> str:
        return ITALICS.get(self.code, ITALICS["en"])

    def clean(self, text: Column) -> Column:
        """The text steps of a line."""
        if self.text_steps is None:
            return mid_process(text, self.language)
        for step in self.text_steps:
            text = step(text)
        return text
