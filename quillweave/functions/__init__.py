"""Column functions: URLs, HTML text and links, hashes, encodings, dates, robots policies."""
