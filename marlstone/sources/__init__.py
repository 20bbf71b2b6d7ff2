"""Calendars of sessions."""
