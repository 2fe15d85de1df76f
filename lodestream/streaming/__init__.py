from lodestream.streaming.ordered_stream import keyed_state, revise_in_order
from lodestream.streaming.revise_stream import revise_stream

__all__ = ["keyed_state", "revise_in_order", "revise_stream"]
