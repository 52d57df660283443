"""Documents as ciphertext: AES-GCM over each row, with the key column left in the clear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.fields import quoted


def _secret(key: bytes):
    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    return F.lit(bytearray(key))


#: times keep their microseconds
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def seal(df: DataFrame, key: bytes, clear: str = "_id") -> DataFrame:
    """``clear`` and ``sealed``: all other columns as JSON, encrypted. Each row has a random nonce of its own.

    Null fields are left out; a row whose fields are all null seals an empty document.
    """
    rest = [c for c in df.columns if c != clear]
    text = F.to_json(F.struct(*[F.col(quoted(c)) for c in rest]), _FORMATS) if rest else F.lit("{}")
    return df.select(F.col(quoted(clear)), F.aes_encrypt(text.cast("binary"), _secret(key), F.lit("GCM")).alias("sealed"))


def unseal(df: DataFrame, key: bytes, schema: T.StructType | str, clear: str = "_id") -> DataFrame:
    """What seal() took, under ``schema`` (without ``clear``). A wrong key or a changed row is an error."""
    plain = F.aes_decrypt(F.col("sealed"), _secret(key), F.lit("GCM")).cast("string")
    fields = F.from_json(plain, schema.json() if isinstance(schema, T.StructType) else schema, _FORMATS)
    return df.select(F.col(quoted(clear)), fields.alias("__doc")).select(quoted(clear), "__doc.*")
