"""Message sources: archive files, JSON lines and provider API documents."""
