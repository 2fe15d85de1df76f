from lodestream.functions.text import iso_millis, line_count

__all__ = ["iso_millis", "line_count"]
