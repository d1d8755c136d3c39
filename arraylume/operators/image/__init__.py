"""Images as packed rows: image_id, width, height, encoding and pixel arrays."""
