"""polyscene: multimodal evidence analytics as DataFrame plans."""
