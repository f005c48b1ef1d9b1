"""DataFrame operators over the inspection store."""
