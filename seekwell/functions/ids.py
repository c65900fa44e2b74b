"""Content hashes and deterministic identifiers, all computed in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import UUID_NS_DNS, UUID_NS_OID


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """RFC 4122 version-5 id of `name` in a name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    # the variant digit keeps its two low bits under the fixed bits 10
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def chunk_id(path: Column, index: Column) -> Column:
    """Id of a chunk from the absolute path of its file and its position."""
    return uuid5(UUID_NS_DNS, F.concat(path, F.lit(":"), index.cast("string")))


def chunk_id_hash_form(path: Column, index: Column) -> Column:
    """The other id form: id of the folder-relative path, `#`, position."""
    return F.concat(uuid5(UUID_NS_OID, path), F.lit("#"), index.cast("string"))


def folder_key(folder: Column, prefix: str = "idx-") -> Column:
    """Short storage name of a folder."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(folder.cast("binary"), 256), 1, 16))


#: Most partitions that folders are dealt to: a 64-bit mask holds a set of them. Tables
#: with fewer have a power of two, so that their partition follows from this one.
FOLDER_PARTS = 64


def folder_part(folder: Column, parts: int = FOLDER_PARTS) -> Column:
    """The partition of a folder in the stored tables."""
    return F.pmod(F.crc32(folder.cast("binary")), F.lit(parts)).cast("int")
