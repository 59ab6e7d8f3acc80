"""Stateful parts: the campaign lifecycle, exactly-once application of events, sync cursors."""
