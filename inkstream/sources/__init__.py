"""Feed, OPML and snapshot formats."""
