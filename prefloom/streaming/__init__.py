"""The record expressions on a stream: same plan, unbounded input."""
