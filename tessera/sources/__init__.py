"""Readers and writers of image and video files. Files are rows of a binary column; parsing runs where the file is."""
