"""Everything here is a batch over whole tables; no operator needs a stream. Kept for sources that arrive as one."""
