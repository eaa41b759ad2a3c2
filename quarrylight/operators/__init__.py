"""DataFrame operators: ranking, dedupe, evidence, conversation windows, chunks, keyed state."""
