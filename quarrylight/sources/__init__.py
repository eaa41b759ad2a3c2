"""Scans of landed files: feeds, robots texts, attachments, provider payloads, source trees; and their sinks."""
