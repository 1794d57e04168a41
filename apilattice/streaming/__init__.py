"""Message streams: parsing, classification, correlation, session states."""
