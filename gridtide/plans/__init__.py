"""Plan shapes that keep ordered work distributed."""
