"""Sources: constant text, replayed vectors, raw file chunks, and media containers, which are loaded when first asked for."""

from rillwork.sources.basic import chunk_column, constant_text, file_chunks, ranged_chunks, vector, vector_rows

_MEDIA = ("media_packets", "media_streams", "register_media", "write_avi")
__all__ = ["chunk_column", "constant_text", "file_chunks", "ranged_chunks", "vector", "vector_rows", *_MEDIA]


def __getattr__(name: str):
    if name in _MEDIA:
        from rillwork.sources import media

        return getattr(media, name)
    raise AttributeError(name)
