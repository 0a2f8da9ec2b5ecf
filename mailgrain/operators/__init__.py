"""DataFrame-to-DataFrame operators over message, contact, thread, event and vector tables."""
