"""Readers and writers: code graphs in SQLite, git history, source trees, OTLP payloads, registries and stores."""
