"""Where bars, ticks and other inputs come from."""
