from .events import EventView, canonical, event_view

__all__ = ["EventView", "canonical", "event_view"]
