"""The catalogue of embedding models, and checks of what was fetched. Nothing is downloaded here."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass


@dataclass(frozen=True)
class Model:
    name: str
    repository: str
    revision: str
    license: str
    dims: int
    pooling: str
    query_prefix: str = ""
    passage_prefix: str = ""
    max_tokens: int = 512

    @property
    def recipe(self) -> str:
        """What vectors depend on; an index of another recipe is built anew."""
        return f"{self.name}@{self.revision[:12]}/{self.dims}/{self.pooling}/{self.max_tokens}/{self.query_prefix}/{self.passage_prefix}"

    def asked(self, question: str) -> str:
        """A question as the model is given it."""
        return self.query_prefix + question

    def embedder(self, folder: str):
        """Passages to vectors, with the files in a folder."""
        from ..operators.passages import onnx_embedder

        return onnx_embedder(folder, self.passage_prefix, self.pooling, self.max_tokens)


# Published names, commits and settings of the models.
MODELS = {
    m.name: m
    for m in (
        Model("multilingual-e5-small", "intfloat/multilingual-e5-small", "614241f622f53c4eeff9890bdc4f31cfecc418b3", "MIT", 384, "mean", "query: ", "passage: "),
        Model("paraphrase-multilingual-minilm-l12-v2", "Xenova/paraphrase-multilingual-MiniLM-L12-v2", "2c4055b12046f11709e9df2c122e59ffbdc2f900", "Apache-2.0", 384, "mean", max_tokens=128),
        Model("bge-m3", "BAAI/bge-m3", "5617a9f61b028005a4858fdac845db406aefb181", "MIT", 1024, "cls", max_tokens=1024),
    )
}


def verify(path: str, sha256: str) -> bool:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest() == sha256
