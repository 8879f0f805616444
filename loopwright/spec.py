"""The task schema: which columns go into a program and which come out."""

from __future__ import annotations

from dataclasses import dataclass

MODULES = ("Predict", "ChainOfThought", "ChainOfThoughtWithHint")


@dataclass(frozen=True)
class TaskSpec:
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    instructions: str = ""
    input_descs: tuple[str, ...] = ()
    output_descs: tuple[str, ...] = ()
    module: str = "Predict"
    hint: str | None = None

    def __post_init__(self) -> None:
        for name in ("inputs", "outputs", "input_descs", "output_descs"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.module not in MODULES:
            raise ValueError(f"unsupported module: {self.module}")

    @property
    def fields(self) -> tuple[str, ...]:
        return self.inputs + self.outputs

    @property
    def signature(self) -> str:
        return f"{', '.join(self.inputs)} -> {', '.join(self.outputs)}"

    @property
    def reasons(self) -> bool:
        return self.module != "Predict"

    def description_of(self, field: str) -> str:
        for names, texts in ((self.inputs, self.input_descs), (self.outputs, self.output_descs)):
            if field in names:
                position = names.index(field)
                if position < len(texts) and texts[position]:
                    return texts[position]
        return "${" + field + "}"
