"""The token id space, code digits, flattening and document layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 5


@dataclass(frozen=True)
class Vocabulary:
    """Audio ids of all codebooks, then begin, id mark, ten digits and end."""

    codebooks: int
    size: int = 1024

    def __post_init__(self):
        if self.codebooks < 1 or self.size < 1 or self.total > 65_536:
            raise ValueError("vocabulary does not fit 16 bits")

    @property
    def audio(self) -> int:
        return self.codebooks * self.size

    bos = property(lambda self: self.audio)
    id_mark = property(lambda self: self.audio + 1)
    digit0 = property(lambda self: self.audio + 2)
    eos = property(lambda self: self.audio + 12)
    total = property(lambda self: self.audio + 13)

    def to_dict(self) -> dict:
        return {"num_codebooks": self.codebooks, "codebook_size": self.size}

    @classmethod
    def from_dict(cls, d: dict) -> Vocabulary:
        return cls(int(d["num_codebooks"]), int(d["codebook_size"]))

    def audio_token(self, codebook: Column, code: Column) -> Column:
        ok = codebook.between(0, self.codebooks - 1) & code.between(0, self.size - 1)
        return F.when(ok, codebook * self.size + code).otherwise(F.raise_error(F.lit("audio code out of range")).cast("int"))

    def encode_code(self, code: Column) -> Column:
        ok = code.rlike(f"^[0-9]{{{DIGITS}}}$")
        return F.when(ok, F.transform(F.sequence(F.lit(1), F.lit(DIGITS)), lambda i: F.substring(code, i, F.lit(1)).cast("int") + self.digit0)).otherwise(F.raise_error(F.lit("not a five-digit code")).cast("array<int>"))

    def decode_code(self, ids: Column) -> Column:
        return F.array_join(F.transform(ids, lambda t: (t - self.digit0).cast("string")), "")

    def flatten(self, codes: Column) -> Column:
        """ARRAY<ARRAY> by codebook and frame to ids, all codebooks of a frame together."""
        frames = F.size(F.element_at(codes, 1))
        return F.flatten(F.transform(F.sequence(F.lit(1), frames), lambda t: F.transform(codes, lambda c, q: F.element_at(c, t) + q * self.size)))

    def unflatten(self, ids: Column) -> Column:
        frames = F.size(ids) / self.codebooks
        return F.transform(F.sequence(F.lit(0), F.lit(self.codebooks - 1)), lambda q: F.transform(F.sequence(F.lit(0), frames.cast("int") - 1), lambda t: F.element_at(ids, t * self.codebooks + q + 1) - q * self.size))

    def layout_ok(self, ids: Column) -> Column:
        """Whole frames, each id in its codebook's range."""
        return (F.size(ids) % self.codebooks == 0) & F.forall(F.transform(ids, lambda t, i: F.floor(t / self.size) == i % self.codebooks), lambda x: x)

    def document(self, audio: Column, code: Column) -> Column:
        return F.concat(F.array(F.lit(self.bos)), audio, F.array(F.lit(self.id_mark)), self.encode_code(code), F.array(F.lit(self.eos)))

    def prompt(self, audio: Column) -> Column:
        return F.concat(F.array(F.lit(self.bos)), audio, F.array(F.lit(self.id_mark)))

    def masks(self, n_audio: Column) -> dict[str, Column]:
        """Masks over next-token labels (length n_audio + 7): audio, digits, boundary."""
        labels = F.sequence(F.lit(0), n_audio + 6)
        return {
            "audio": F.transform(labels, lambda i: i < n_audio),
            "digits": F.transform(labels, lambda i: (i > n_audio) & (i < n_audio + 6)),
            "boundary": F.transform(labels, lambda i: (i == n_audio) | (i == n_audio + 6)),
        }

    def pad(self, ids: Column, length: Column) -> Column:
        return F.concat(ids, F.array_repeat(F.lit(self.bos), (length - F.size(ids)).cast("int")))

    def replace_audio(self, ids: Column, audio: Column) -> Column:
        """The document with its audio span overwritten by tokens of the same number."""
        return F.concat(F.slice(ids, 1, 1), audio, F.slice(ids, F.size(audio) + 2, F.size(ids)))


def residual_codes(x: Column, books: list[list[float]]) -> Column:
    """Residual scalar quantisation with nearest entries: codes by book and sample (a small stand-in for a neural quantiser)."""
    def nearest(book):
        entries = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(book)))
        return lambda v: F.array_min(F.transform(entries, lambda b: F.struct(F.abs(v - b["c"]).alias("d"), b["i"].alias("i"), b["c"].alias("c"))))

    rest, out = x, []
    for near in map(nearest, books):
        met = F.transform(rest, near)
        out.append(F.transform(met, lambda m: m["i"]))
        rest = F.zip_with(rest, met, lambda v, m: v - m["c"])
    return F.array(*out)
